"""Registered queries by family."""

from __future__ import annotations

from . import code, context, general, graphs, ranking, reports, texts
from .registry import Registry


def registries() -> list[Registry]:
    return [ranking.REGISTRY, graphs.REGISTRY, code.REGISTRY, context.REGISTRY, reports.REGISTRY, texts.REGISTRY, general.REGISTRY]

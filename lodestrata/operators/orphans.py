"""References whose key no row of the target table has."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphan_references(
    refs: DataFrame, ref_cols: Sequence[str], target: DataFrame, key_cols: Sequence[str], match: str = "simple"
) -> DataFrame:
    """The distinct rows of ``refs`` whose reference has no target.

    The references are first reduced to distinct rows, which takes any hot key down to one row a group,
    and are then split by null mask: which of ``ref_cols`` are null. Each mask is anti-joined on its
    non-null columns alone. ``match`` is the declared semantics for partly null keys, as in SQL:
    'simple' takes them as no references; 'partial' wants a target that agrees on the non-null columns;
    'full' reports them. A wholly null key is a reference under none. Keys match character for character.
    Other columns of ``refs`` stay; an empty target makes all references orphans.
    """
    if match not in ("simple", "partial", "full") or len(ref_cols) != len(key_cols) or not ref_cols:
        raise ValueError("match is simple, partial or full, with as many reference as key columns")
    rows = refs.distinct()
    keys = target.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key_cols)))
    found = []
    for mask in product((False, True), repeat=len(ref_cols)):  # True: null
        if all(mask) or any(mask) and match == "simple":
            continue
        part = rows.where(reduce(Column.__and__, (F.col(c).isNull() if m else F.col(c).isNotNull() for c, m in zip(ref_cols, mask, strict=True))))
        if not (any(mask) and match == "full"):
            on = [(c, f"__k{i}") for i, (c, m) in enumerate(zip(ref_cols, mask, strict=True)) if not m]
            side = keys.select(*(k for _, k in on))
            part = part.join(side, reduce(Column.__and__, (part[c] == side[k] for c, k in on)), "left_anti")
        found.append(part)
    return reduce(DataFrame.unionByName, found)


def orphan_report(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of distinct orphan keys per table and period, from the rows of ``orphan_references``."""
    return parts.groupBy(*by).agg(F.count("*").alias("orphans"))

"""The tokenizer of ``functions.text`` for whole batches in Python.

As one SQL expression it works out stems and abbreviations anew for every token, which took ten times as
long as this with its memory of the tokens seen. Both give the same tokens.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ABBREVIATIONS, STEM_RULES

_CAMEL, _RUN = re.compile("([a-z])([A-Z])"), re.compile("[a-zA-Z0-9]{2,}")


@lru_cache(maxsize=200_000)
def stem_word(word: str) -> str:
    if len(word) < 5:
        return word
    for suffix, to, least in STEM_RULES:
        if word.endswith(suffix) and len(word) >= len(suffix) + least:
            return word[: -len(suffix)] + to
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


@lru_cache(maxsize=200_000)
def other_forms(word: str) -> tuple[str, ...]:
    """The stem of a token and what it and its stem stand for."""
    stem = stem_word(word)
    return tuple(dict.fromkeys([stem, *ABBREVIATIONS.get(word, "").split(), *ABBREVIATIONS.get(stem, "").split()]))


def text_tokens(text: str | None) -> list[str]:
    """The tokens of one text, as ``functions.text.tokens`` gives them, in another order."""
    out: list[str] = []
    seen: set[str] = set()
    for run in _RUN.findall(_CAMEL.sub(r"\1_\2", text or "")):
        token = run.lower()
        out.append(token)
        seen.add(token)
        for form in other_forms(token):
            if form not in seen:
                out.append(form)
                seen.add(form)
    return out


def profile(fields: Sequence[str], weights: Sequence[int], terms: Sequence[str], lists: Sequence[bool]) -> Column:
    """A struct of dl, the number of distinct tokens in all ``fields``, tf, the weighted frequency of each term,
    and counts, its frequency in each field.

    ``lists`` tells which fields hold lists, whose elements are tokens as they are, in lower case.
    """
    wanted, width = {t: i for i, t in enumerate(terms)}, len(fields)

    def run(*columns: pd.Series) -> pd.DataFrame:
        lengths, counts, weighted = [], [], []
        for row in zip(*columns):
            every: set[str] = set()
            found = [0] * (len(wanted) * width)
            for j, value in enumerate(row):
                bag = ([w.lower() for w in value if w is not None] if value is not None else []) if lists[j] else text_tokens(value)
                every.update(bag)
                for token in bag:
                    if token in wanted:
                        found[wanted[token] * width + j] += 1
            lengths.append(len(every))
            counts.append(found)
            weighted.append([sum(w * n for w, n in zip(weights, found[i : i + width])) for i in range(0, len(found), width)])
        return pd.DataFrame({"dl": pd.array(lengths, dtype="int32"), "tf": weighted, "counts": counts})

    # not pushed through filters, as it would be run once more for every use
    return F.pandas_udf(run, "struct<dl:int,tf:array<int>,counts:array<int>>").asNondeterministic()(*fields)


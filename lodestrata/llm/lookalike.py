"""One consistent form for texts that look the same but are written with different characters.

The words of the corpus that are written plainly make up a vocabulary, kept as a trie. Each token of a
text is run through it by an edit automaton with weights: look-alike letters replace each other at cost
zero, ignorable characters drop out at cost zero, anything else costs one. The token takes the spelling
it reaches within the bound of zero, the most frequent one if there are several. Tokens that reach none
are spelt by table. Blanks of every kind become spaces; line ends, letter case, accents and digits stay.

A token is first composed, with full and half widths folded. The trie is a bounded part of the
vocabulary: the most frequent words. This bound changes which spelling is chosen, never which texts come
out equal: all spellings that look alike reach the same words, or the same entry of the table.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cuts

#: Words kept in the trie, a bound on what is broadcast.
VOCABULARY = 50_000
# Letters that look like a Latin letter, by that letter.
LOOKALIKES = {
    "a": "аαɑ", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "е℮", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ",
    "k": "кκ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝѡ",
    "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ",
    "Z": "Ζ",
}
# Characters that leave no mark on the page, and kinds of blank of one line.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯﻿︀-️\U000e0000-\U000e0fff"
BLANKS = "   -   　"
PROTOTYPE = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others}
_IGNORED, _BLANK = regex.compile(f"[{IGNORABLE}]+"), regex.compile(f"[{BLANKS}]")
_WIDE = regex.compile("[！-～｡-ￜ￠-￮]+")
_TOKEN, _ASCII = regex.compile(r"[\p{L}\p{M}]+"), re.compile("[A-Za-z]+")
#: Letters that have look-alikes: only tokens with one of them can be spelt in several ways.
_MIXABLE = frozenset(LOOKALIKES) | frozenset(map(chr, PROTOTYPE))
IGNORED_COST, SAME_COST, LOOKALIKE_COST, OTHER_COST = 0, 0, 0, 1


def fold(text: str) -> str:
    """Widths folded, ignorables gone, blanks as spaces, accents composed: all that is no matter of spelling."""
    if text.isascii():
        return text
    text = _BLANK.sub(" ", _IGNORED.sub("", text))
    if _WIDE.search(text):
        text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def by_table(token: str) -> str:
    """The spelling of a token that no word of the vocabulary looks like."""
    return token.translate(PROTOTYPE)


class Trie:
    """A vocabulary with its frequencies, walked by the edit automaton."""

    def __init__(self, words: Sequence[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = (n, word)

    def spell(self, token: str, bound: int = 0) -> str | None:
        """The word that ``token`` reaches at the least cost within ``bound``; of several the most frequent one.

        A state is a node with the cost so far. A character moves on to itself and to its look-alikes for
        nothing, stays where it is for nothing if ignorable, and otherwise moves to any other for one.
        """
        states: list[tuple[dict, int]] = [(self.root, 0)]
        for c in token:
            moved: list[tuple[dict, int]] = []
            alike = _ALIKE.get(c, c)
            if c not in _ALIKE and not c.isascii() and _IGNORED.match(c):
                moved += [(node, cost + IGNORED_COST) for node, cost in states]
            for node, cost in states:
                for other in alike:
                    if other in node:
                        moved.append((node[other], cost + (SAME_COST if other == c else LOOKALIKE_COST)))
                if cost + OTHER_COST <= bound:
                    moved += [(child, cost + OTHER_COST) for other, child in node.items() if other and other not in alike]
            states = moved
            if not states:
                return None
        ends = [(cost, -node[""][0], node[""][1]) for node, cost in states if "" in node]
        return min(ends)[2] if ends else None


_ALIKE: dict[str, str] = {}
for _latin, _others in LOOKALIKES.items():
    for _c in _latin + _others:
        _ALIKE[_c] = _latin + _others


class Speller:
    """Canonical forms of texts by one vocabulary; keeps the spelling of tokens seen, up to a fixed number."""

    def __init__(self, words: Sequence[tuple[str, int]], kept: int = 300_000):
        self.trie, self.seen, self.kept = Trie(words), {}, kept

    def token(self, token: str) -> str:
        out = self.seen.get(token)
        if out is None:
            out = (self.trie.spell(token) or by_table(token)) if not _MIXABLE.isdisjoint(token) else token
            if len(self.seen) >= self.kept:
                self.seen.clear()
            self.seen[token] = out
        return out

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        text = fold(text)
        # each token of a text is spelt once, and few texts have one that changes
        changed = {t: out for t in set((_ASCII if text.isascii() else _TOKEN).findall(text)) if (out := self.seen.get(t) or self.token(t)) != t}
        return _TOKEN.sub(lambda m: changed.get(m[0], m[0]), text) if changed else text


#: the one speller of a worker, by the vocabulary it was made from
_SPELLERS: dict[str, Speller] = {}


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> list[tuple[str, int]]:
    """The most frequent plainly spelt words and in how many places they stand: words of one script.

    Counted over all texts; ``size`` bounds what comes to the driver.
    """
    plain = r"(?<![\p{L}\p{M}])(?:[A-Za-z\x{00c0}-\x{024f}]+|\p{IsCyrillic}+|\p{IsGreek}+)(?![\p{L}\p{M}])"
    words = docs.where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(plain), 0)).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [(r["word"], r["n"]) for r in top.collect()]


def canonical_texts(docs: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """doc_id, text, canonical of each row of ``docs`` (doc_id, text); a null text has a null form.

    Rows stay as many as they are, so drop repeated ones before.
    """
    cuts = Cuts(docs.sparkSession)
    docs = cuts.cut(docs.select("doc_id", "text"))
    words = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary(docs, size)))

    def spell(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key, listed = words.value
        if key not in _SPELLERS:
            _SPELLERS.clear()
            _SPELLERS[key] = Speller(listed)
        for s in texts:
            yield pd.Series([_SPELLERS[key].text(t) for t in s], dtype=object)

    # not pushed through filters, as it would be run once more for them
    return docs.select("doc_id", "text", F.pandas_udf(spell, "string").asNondeterministic()("text").alias("canonical"))


def same_looking_pairs(canonical: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b with doc_id_a < doc_id_b: pairs with one canonical form and different texts.

    Rows have doc_id, text and canonical; null, empty and blank texts are in no pair. Only digests travel.
    The spellings of a form are counted first, and just forms with several spellings are joined: each
    spelling with the others, never a spelling with itself, so copies of one text make no pairs.
    """
    cuts = Cuts(canonical.sparkSession)
    rows = canonical.where("doc_id is not null and canonical rlike '[^\\\\s]'").select("doc_id", F.unhex(F.md5("canonical")).alias("form"), F.unhex(F.md5("text")).alias("raw"))
    rows = cuts.cut(rows.distinct())
    several = rows.groupBy("form").agg((F.min("raw") != F.max("raw")).alias("several")).where("several").select("form")
    mixed = cuts.cut(rows.join(several, "form", "left_semi"))
    other = mixed.select("form", F.col("doc_id").alias("doc_id_b"), F.col("raw").alias("raw_b"))
    pairs = mixed.join(other, "form").where((F.col("doc_id") < F.col("doc_id_b")) & (F.col("raw") != F.col("raw_b")))
    return pairs.select(F.col("doc_id").alias("doc_id_a"), "doc_id_b")


def spellings(canonical: DataFrame) -> DataFrame:
    """doc_id, form_id (smallest doc_id of its form), spelling (number of its spelling): groups without pairs."""
    rows = canonical.where("canonical rlike '[^\\\\s]'").select("doc_id", F.md5("canonical").alias("form"), F.md5("text").alias("raw"))
    kinds = rows.groupBy("form", "raw").agg(F.min("doc_id").alias("first"))
    named = kinds.withColumn("form_id", F.min("first").over(Window.partitionBy("form"))).withColumn("spelling", F.dense_rank().over(Window.partitionBy("form").orderBy("first")))
    return rows.join(named.drop("first"), ["form", "raw"]).select("doc_id", "form_id", "spelling")

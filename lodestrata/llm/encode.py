"""Encoding of a whole corpus with a public byte-level BPE tokenizer, split at forced boundaries.

A pair of bytes that stands inside no vocabulary token can never be merged over, so a cut between the two
is certain: what lies left and right of it is encoded on its own and put together again. The table of such
pairs is made from the vocabulary. Texts are first cut before white space, as nearly all of these cuts are
certain by the table, and the others are made by the pre-tokenizer; then each stretch is pre-tokenized
and each piece cut at all its certain byte pairs.

Stretches and pieces repeat very often, so each worker keeps the ids of those it has seen, up to a fixed number.
Texts of over ``long_chars`` characters become rows of their own, one for every so many characters, so
that one very long text is shared by many tasks and only its ids come together again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pre-tokenizer pattern of the vocabulary, and white space as it understands it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANKS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
FRAGMENT = re.compile(rf"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
PIECES = regex.compile(PATTERN)
#: How many stretches and pieces a worker keeps, and the longest that it keeps.
KEPT, SHORT = 200_000, 48


class ForcedBoundaryEncoder:
    """Encodes texts by one vocabulary of ranks. Null and empty texts have the empty list of ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        joined = bytearray(65536)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                joined[a << 8 | b] = 1
        #: joined[a << 8 | b]: whether some token holds byte a before byte b
        self.joined = bytes(joined)
        self.seen: dict[str, list[int]] = {}
        self.pieces: dict[str, list[int]] = {}

    def certain_cut(self, a: int, b: int) -> bool:
        """Whether no token holds byte a before byte b, so that a text may always be cut between them."""
        return not self.joined[a << 8 | b]

    def forced(self, piece: bytes) -> list[bytes]:
        """A piece cut at all its certain byte pairs."""
        joined = self.joined
        at = [0, *(i for i in range(1, len(piece)) if not joined[piece[i - 1] << 8 | piece[i]]), len(piece)]
        return [piece[a:b] for a, b in zip(at, at[1:])]

    def _piece(self, piece: str) -> list[int]:
        """The ids of a piece: its fragments between certain byte pairs, each encoded alone."""
        ids: list[int] = []
        for part in self.forced(piece.encode()):
            ids += self.core._encode_single_piece(part)
        if len(piece) <= SHORT:
            if len(self.pieces) >= KEPT:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _stretch(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in PIECES.findall(text):
            ids += self.pieces.get(piece) or self._piece(piece)
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        seen = self.seen
        for stretch in FRAGMENT.findall(text):
            part = seen.get(stretch)
            if part is None:
                part = self._stretch(stretch)
                if len(stretch) <= SHORT:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen[stretch] = part
            ids += part
        return ids

    def blocks(self, text: str, size: int) -> list[str]:
        """The text in blocks of about ``size`` characters, cut between fragments."""
        out, start, end = [], 0, 0
        for m in FRAGMENT.finditer(text):
            end = m.end()
            if end - start >= size:
                out.append(text[start:end])
                start = end
        return [*out, text[start:]] if start < len(text) else out


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder a worker and vocabulary."""
    return ForcedBoundaryEncoder(path)


def _long_blocks(docs: DataFrame, vocabulary: str, long_chars: int) -> DataFrame:
    """doc_id, part, text of the long texts; they are spread over the cluster before they are encoded."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                parts = encoder(vocabulary).blocks(text, long_chars)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    yield pd.DataFrame({"doc_id": [doc] * len(some), "part": range(at, at + len(some)), "text": some})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.length("text") > long_chars).select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, part int, text string").repartition("doc_id", "part")


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY, long_chars: int = 200_000) -> DataFrame:
    """doc_id, ids: the token ids of each row of ``docs`` (doc_id, text), without special tokens.

    Null and empty texts have the empty list. Strings that look like special tokens are ordinary text. Rows
    stay as many as they are, so drop repeated ones before.
    """
    def ids_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder(vocabulary).encode
        for s in texts:
            yield pd.Series([run(t) for t in s])

    ids = F.pandas_udf(ids_of, "array<int>")
    short = docs.where(F.col("text").isNull() | (F.length("text") <= long_chars)).select("doc_id", ids("text").alias("ids"))
    parts = _long_blocks(docs, vocabulary, long_chars).select("doc_id", "part", ids("text").alias("ids"))
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p")).select("doc_id", F.flatten("p.ids").alias("ids"))
    return short.unionByName(whole)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, long_chars: int = 200_000, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, n_tokens: the number of tokens of each row; 0 for null and empty texts."""

    def count_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder(vocabulary).encode
        for s in texts:
            yield pd.Series([len(run(t)) for t in s], dtype="int64")

    count = F.pandas_udf(count_of, "bigint").asNondeterministic()  # not run once more for a filter on the counts
    short = docs.where(F.col("text").isNull() | (F.length("text") <= long_chars)).select("doc_id", *keep, count("text").alias("n_tokens"))
    parts = _long_blocks(docs, vocabulary, long_chars).select("doc_id", count("text").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))
    return short.unionByName(docs.where(F.length("text") > long_chars).select("doc_id", *keep).join(parts, "doc_id").select("doc_id", *keep, "n_tokens"))

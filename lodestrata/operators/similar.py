"""Clusters of similar records by an exact join of their term sets.

Pairs above the threshold are edges of a graph, and its components are the clusters. No term is left out
for being common: the threshold itself says how many terms two sets must share, so some of the rarest
terms of either are shared, and only records that share three or more of those, or all they must, are compared.

A term's records come together once, in a bucket of terms; there the pairs are found in arrays. Who only wants
counts, the nearest or the clusters has these put together bucket by bucket, so the pairs themselves, which grow with the square of
the records, are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cuts
from .graph import components
from .ranking import numbered

#: similarities are whole numbers of this part
UNIT = 1e6
#: how many shared terms records meet by, more where that leaves over so many pairs a choice; how many choices of terms a record may make
TERMS, MANY, CHOICES = 3, 3, 512
#: rows of a bucket, pairs looked at together
BUCKET, CHUNK = 20_000, 1 << 17


def _need(share: float) -> int:
    return max(1, math.ceil(share - 1e-9))


def _coded(df: DataFrame, key: str, terms: str, size: str, cuts: Cuts) -> tuple[DataFrame, DataFrame, int]:
    """r, s, t: records with the distinct codes of their terms in rising order; r, k: their keys, r in the order of keys; how many codes one record alone has, the lowest.

    Rarer terms have lower codes. Records of one key have one r.
    """
    rows = df.select(F.col(key).alias("k"), F.array_compact(F.array_distinct(terms)).alias("t"), F.col(size).cast("double").alias("s")).where((F.size("t") > 0) & F.col("k").isNotNull())
    # ids that grow with the partition, over a sort by ranges, number the records in their order
    rows = rows.orderBy("k").withColumn("at", F.monotonically_increasing_id())
    rows = cuts.cut(rows.withColumn("r", F.min("at").over(Window.partitionBy("k"))))
    each = rows.select("at", F.explode("t").alias("b"))
    words = cuts.cut(each.groupBy("b").agg(F.count("*").alias("n")))
    codes = cuts.cut(numbered(words, [F.asc("n"), F.asc("b")], "c").select("b", F.col("c").cast("int").alias("c")))
    sets = each.join(codes, "b").groupBy("at").agg(F.array_sort(F.collect_list("c")).alias("t"))
    size_of = F.when(F.col("s") > 0, F.col("s")).otherwise(0.0).alias("s")
    out = cuts.cut(rows.select("at", "r", size_of).join(sets, "at").select("r", "s", "t"))
    single = words.where("n = 1").count()
    cuts.drop(words, codes)
    return out, rows.where("r = at").select("r", "k"), single


def _choices(x: np.ndarray, first: np.ndarray, rows: np.ndarray, shared: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rows, places of all choices of k terms, the first that of the row, that can be the first k of ``shared`` terms."""
    n, keys, at, where = x.shape[1], [], [], []
    for i in range(n - shared + 1):
        some = np.flatnonzero(first == i)
        for more in combinations(range(i + 1, n - shared + k), k - 1) if len(some) else ():
            if any(p > n - shared + 1 + at_ for at_, p in enumerate(more)):
                continue
            key = x[some, i].astype(np.int64)
            for p in more:
                key = key * 1_000_003 + x[some, p]
            keys.append(key)
            at.append(rows[some])
            where.append(np.broadcast_to(np.array((i, *more), np.int16), (len(some), k)))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, k), np.int16)
    return np.concatenate(keys), np.concatenate(at), np.concatenate(where)


def _found(table: pa.Table, j: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a bucket (r, s, i, t; i the place of the term that they are here for) two by two, each pair once in all buckets, with its similarity, if that reaches the threshold.

    Sets of n and m terms share ``shared`` or more, so the first k of these stand among the first n - shared + k
    of the one and m - shared + k of the other. By such choices they meet, sizes within the ratio that is needed besides.
    """
    low = threshold - 1e-6  # scores are rounded
    t = table["t"].combine_chunks()
    if isinstance(t, pa.ChunkedArray):
        t = pa.concat_arrays(t.chunks)
    flat, lengths = t.flatten().to_numpy(zero_copy_only=False), t.value_lengths().to_numpy(zero_copy_only=False)
    r, s, place = (table[c].to_numpy() for c in ("r", "s", "i"))
    begin = np.cumsum(lengths) - lengths
    sizes, level = np.unique(s, return_inverse=True)
    by = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    sets = {n: flat[begin[rows][:, None] + np.arange(n)] for n, rows in by.items()}
    inside = np.empty(len(r), np.int64)
    for rows in by.values():
        inside[rows] = np.arange(len(rows))
    for m in by:
        for n in (n for n in by if _need(j * m) <= n <= m):
            shared = min(n, _need(j / (1 + j) * (n + m)))
            least = (low - 0.7 * n / m) / 0.3 * (1 - 1e-9)
            k = min(TERMS, shared)
            while k > 1 and math.comb(m - shared + k, k) > CHOICES:
                k -= 1
            while True:
                key2, b, q = _choices(sets[m], place[by[m]], by[m], shared, k)
                key, a, p = (key2, b, q) if n == m else _choices(sets[n], place[by[n]], by[n], shared, k)
                # keys as ranks with the rank of the size, so that a range of both is one range
                known, rank2 = np.unique(key2, return_inverse=True)
                both2 = rank2 * len(sizes) + level[b]
                order = np.argsort(both2, kind="stable")
                both2, b, q = both2[order], b[order], q[order]
                if n == m:
                    base, a, p = both2 - level[b], b, q
                    start = np.arange(1, len(b) + 1)
                elif len(known):
                    rank = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hit = known[rank] == key
                    base, a, p = rank[hit] * len(sizes), a[hit], p[hit]
                    start = np.searchsorted(both2, base + (np.searchsorted(sizes, s[a] * least) if least > 0 else 0))
                else:
                    base = start = a = a[:0]
                most = np.searchsorted(sizes, s[a] / least, "right") if least > 0 else len(sizes)
                count = np.maximum(np.searchsorted(both2, base + most) - start, 0)
                ends = np.cumsum(count)
                total = int(ends[-1]) if len(ends) else 0
                if total <= MANY * (len(key) + len(key2)) or k == shared or math.comb(m - shared + k + 1, k + 1) > CHOICES:
                    break
                k += 1  # terms that mostly stand together tell little
            for at in range(0, total, CHUNK):
                nth = np.arange(at, min(at + CHUNK, total))
                left = np.searchsorted(ends, nth, "right")
                right = start[left] + nth - (ends[left] - count[left])
                x, y = a[left], b[right]
                small, large = np.minimum(s[x], s[y]), np.maximum(s[x], s[y])
                ratio = 0.3 * np.where(small > 0, small / np.where(large > 0, large, 1.0), 0.0)
                ahead = k + np.minimum(n - 1 - p[left, -1], m - 1 - q[right, -1])
                may = np.flatnonzero((0.7 * ahead / (n + m - ahead) + ratio >= low) & (r[x] != r[y]))
                left, right, x, y, ratio = left[may], right[may], x[may], y[may], ratio[may]
                one, two = sets[n][inside[x]], sets[m][inside[y]]
                hits = np.zeros(one.shape, bool)
                for c in range(m):
                    hits |= one == two[:, c : c + 1]
                same = hits.sum(1)
                score = np.floor(((0.7 * same) / (n + m - same) + ratio) * UNIT + 0.5)
                good = score >= threshold * UNIT - 1e-3
                ends_at = p[left, -1]
                good &= (hits & (np.arange(n) <= ends_at[:, None])).sum(1) == k
                for c in range(k):
                    good &= np.take_along_axis(one, p[left, c : c + 1].astype(np.int64), 1)[:, 0] == np.take_along_axis(two, q[right, c : c + 1].astype(np.int64), 1)[:, 0]
                yield x[good], y[good], score[good].astype(np.int64)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest known node of its part, after edges between a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, further := label[label]):
            label = further


def _buckets(rows: DataFrame, single: int, threshold: float, what: str, shape: str) -> DataFrame:
    """What the buckets of terms hold: ``pairs``, or of each record links with the ``nearest`` or the smallest of its part (``parts``)."""
    j = max((threshold - 1e-6 - 0.3) / 0.7, 0.0)  # scores are rounded
    spark = rows.sparkSession
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * 4 // BUCKET + 1)
    n = F.size("t")
    need = lambda share: F.greatest(F.lit(1), F.ceil(share - 1e-9))
    most = n - need(j / (1 + j) * (n + need(j * n))) + 1
    blocks = rows.select("r", "s", "t", F.posexplode(F.slice("t", F.lit(1), most.cast("int"))).alias("i", "c")).where(F.col("c") > single)
    blocks = blocks.select(F.pmod(F.xxhash64("c"), F.lit(number)).cast("int").alias("bucket"), "r", "s", "i", "t")

    def run(table: pa.Table) -> pa.Table:
        r = table["r"].to_numpy()
        ids, own = np.unique(r, return_inverse=True)
        found = _found(table, j, threshold)
        if what == "pairs":
            got = [(r[a], r[b], score) for a, b, score in found]
            a, b, score = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, np.int64),) * 3
            return pa.table({"src": np.minimum(a, b), "dst": np.maximum(a, b), "d": score})
        links, label, best = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.full(len(ids), np.iinfo(np.int64).max)
        for a, b, score in found:
            a, b = own[a], own[b]
            links += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            if what == "parts":
                label = _join(label, a, b)
                continue
            far = (int(UNIT) - score) << 32
            np.minimum.at(best, a, far | b)
            np.minimum.at(best, b, far | a)
        some = np.flatnonzero(links)
        if what == "parts":
            return pa.table({"r": ids[some], "links": links[some], "o": ids[label[some]]})
        return pa.table({"r": ids[some], "links": links[some], "far": best[some] >> 32, "o": ids[best[some] & 0xFFFFFFFF]})

    return blocks.repartition(number, "bucket").groupBy("bucket").applyInArrow(run, shape)


def similar_pairs(df: DataFrame, key: str, terms: str, size: str, threshold: float = 0.8) -> DataFrame:
    """src, dst, similarity: all pairs of records that share a term and reach the threshold by the Jaccard of their terms (.7) and the ratio of their sizes (.3)."""
    rows, names, single = _coded(df, key, terms, size, Cuts(df.sparkSession))
    found = _buckets(rows, single, threshold, "pairs", "src long, dst long, d long")
    name = lambda c: names.select(F.col("r").alias(c), F.col("k").alias(f"{c}_k"))
    named = found.join(name("src"), "src").join(name("dst"), "dst")
    return named.select(F.col("src_k").alias("src"), F.col("dst_k").alias("dst"), (F.col("d") / UNIT).alias("similarity"))


def similar_nearest(df: DataFrame, key: str, terms: str, size: str, threshold: float = 0.8) -> DataFrame:
    """``nearest`` of ``similar_pairs``."""
    cuts = Cuts(df.sparkSession)
    rows, names, single = _coded(df, key, terms, size, cuts)
    found = _buckets(rows, single, threshold, "nearest", "r long, links long, far long, o long")
    best = cuts.cut(found.groupBy("r").agg(F.sum("links").alias("links"), F.min(F.struct("far", "o")).alias("b")).select("r", "links", "b.far", "b.o"))
    cuts.drop(rows)
    named = best.join(names.select("r", F.col("k").alias("id")), "r").join(names.select(F.col("r").alias("o"), F.col("k").alias("nearest")), "o")
    return named.select("id", "links", "nearest", ((UNIT - F.col("far")) / UNIT).alias("similarity"))


def similar_clusters(df: DataFrame, key: str, terms: str, size: str, threshold: float = 0.8) -> DataFrame:
    """``clusters`` of ``similar_pairs``."""
    cuts = Cuts(df.sparkSession)
    rows, names, single = _coded(df, key, terms, size, cuts)
    found = cuts.cut(_buckets(rows, single, threshold, "parts", "r long, links long, o long"))
    cuts.drop(rows)
    links = found.groupBy(F.col("r").alias("id")).agg(F.sum("links").alias("links"))
    # the smallest number has the smallest key
    parts = components(found.select(F.col("r").alias("src"), F.col("o").alias("dst")))
    named = parts.join(links, "id").join(names.select(F.col("r").alias("id"), F.col("k").alias("id_k")), "id").join(names.select(F.col("r").alias("component"), F.col("k").alias("component_k")), "component")
    return named.select(F.col("id_k").alias("id"), F.col("component_k").alias("component"), "links")


def nearest(pairs: DataFrame) -> DataFrame:
    """id, links, nearest, similarity: each record of a pair with the number of its pairs and the record it is most like, on a tie the smallest."""
    ends = pairs.select(F.col("src").alias("id"), F.col("dst").alias("other"), "similarity").unionByName(pairs.select(F.col("dst").alias("id"), F.col("src").alias("other"), "similarity"))
    best = ends.groupBy("id").agg(F.count("*").alias("links"), F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("b"))
    return best.select("id", "links", F.col("b.other").alias("nearest"), (-F.col("b.s")).alias("similarity"))


def clusters(pairs: DataFrame) -> DataFrame:
    """id, component, links: each record of a pair with its cluster and the number of its pairs."""
    links = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
    return components(pairs).join(links, "id")

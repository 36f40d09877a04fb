"""Ranked retrieval over records with text fields.

Query terms are known when the plan is made. So one pass over the records gives, in the row itself, its
length and the weighted frequency of each query term; the counts of the collection are one row, which is
broadcast; the top rows are taken without a full sort. No postings are built or shuffled. The tokenizer
runs in Python over whole batches, which was measured to be the faster way.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from functools import reduce
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import confidence, cosine, identity_score
from ..functions.text import trigrams
from ..functions.tokenize import profile
from ..session import Cuts

K1, B, CENTRALITY, SMOOTHING = 1.5, 0.75, 0.3, 60
#: how often the terms of a field count
FIELD_WEIGHTS = {"name": 3, "keywords": 2, "signature": 2, "summary": 1, "docstring": 1}


def profiled(df: DataFrame, terms: Sequence[str], fields: Mapping[str, int] = FIELD_WEIGHTS) -> DataFrame:
    """``df`` with dl, the number of distinct terms, tf, the weighted frequency of each query term, and counts,
    its frequency in each field, term by term.

    String fields are tokenized, list fields taken as they are in lower case; nulls have no terms.
    """
    kinds, names = dict(df.dtypes), list(fields)
    rows = df.withColumn("p_", profile(names, list(fields.values()), terms, [kinds[f].startswith("array") for f in names]))
    return rows.select(*df.columns, "p_.*")


def _gain(tf: Column, df: Column) -> Column:
    """What a term adds to a score, from its frequency in the record and its number of records."""
    idf = F.log((F.col("n_") - df + 0.5) / (df + 0.5) + 1)
    length = K1 * (1 - B + B * F.col("dl") / F.col("avgdl_"))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + length)).otherwise(0.0)


def bm25(df: DataFrame, terms: Sequence[str], fields: Mapping[str, int] = FIELD_WEIGHTS, split: bool = False) -> DataFrame:
    """``df`` with the column lexical, its BM25 score, of the records that hold one of ``terms``.

    Term frequencies are weighted by field, lengths count distinct terms, each query term counts once.
    ``split`` adds a column s_FIELD for the score of each field taken alone.
    """
    terms = list(dict.fromkeys(terms))
    rows = _profiled_once(df, terms, fields)
    stats = collection_stats(rows, len(terms))
    scores = {"lexical": sum((_gain(F.col("tf")[i], F.col("df_")[i]) for i in range(len(terms))), F.lit(0.0))}
    if split:
        at = lambda i, j: F.col("counts")[i * len(fields) + j]
        scores |= {f"s_{f}": sum((_gain(w * at(i, j), F.col("df_")[i]) for i in range(len(terms))), F.lit(0.0)) for j, (f, w) in enumerate(fields.items())}
    joined = rows.where("hit").crossJoin(F.broadcast(stats))  # stats is one row
    return joined.select(*df.columns, *(e.alias(c) for c, e in scores.items()))


def _profiled_once(df: DataFrame, terms: Sequence[str], fields: Mapping[str, int]) -> DataFrame:
    """The profiles written once, as both the counts of the collection and the scores need them; texts are kept
    with the records that are hit, which are few."""
    rows = profiled(df, terms, fields).withColumn("hit", F.array_max("tf") > 0)
    kept = [F.when(F.col("hit"), F.col(c)).alias(c) for c in df.columns]
    return Cuts(df.sparkSession).cut(rows.select("hit", "dl", "tf", "counts", *kept))


def collection_stats(rows: DataFrame, n_terms: int) -> DataFrame:
    """One row: n_ records, their average length avgdl_, and the list df_, how many hold each query term."""
    hits = F.array(*(F.count_if(F.col("tf")[i] > 0) for i in range(n_terms)))
    return rows.agg(F.count("*").alias("n_"), F.avg("dl").alias("avgdl_"), hits.alias("df_"))


def search(df: DataFrame, terms: Sequence[str], key: str, k: int, centrality: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """The k best records: lexical and identity score, plus centrality where there is a score at all.

    ``centrality`` has the column ``on`` and n, a count of what points there. Ties go by ``key``.
    """
    rows = bm25(df, terms).withColumn("identity", identity_score(F.col("name"), F.col(key), " ".join(terms), "_".join(terms)))
    score = F.col("lexical") + F.col("identity")
    if centrality is not None:
        rows = rows.join(centrality.select(on, "n"), on, "left")
        score = score + F.when(score > 0, CENTRALITY * F.log1p(F.coalesce("n", F.lit(0)))).otherwise(0.0)
    return top_k(rows.withColumn("score", F.round(score, 6)).where("score > 0"), k, [F.desc("score"), F.asc(key)])


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows of an order with a unique end; planned as a bounded heap in each task."""
    return df.orderBy(*order).limit(k)


def hybrid(df: DataFrame, lexical: str, similarity: str, weight: float = 0.5) -> DataFrame:
    """``df`` with the column hybrid: the lexical score by its maximum, blended with a similarity; 0 and less drop out."""
    most = df.agg(F.max(lexical).alias("most_"))
    scaled = F.when(F.col("most_") > 0, F.col(lexical) / F.col("most_")).otherwise(0.0)
    return df.crossJoin(F.broadcast(most)).withColumn("hybrid", (1 - weight) * scaled + weight * F.col(similarity)).drop("most_").where("hybrid > 0")  # one row


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its place from 1 in one order over all rows, which must have a unique end.

    The rows are sorted by ranges and written once; a row's place is its place in its range and the number of rows
    of the ranges before, so no task holds more than a range.
    """
    rows = Cuts(df.sparkSession).cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inner = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"), F.min(inner).alias("__0"))
    before = Window.partitionBy(F.lit(1)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    first = sizes.select("__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__0")).alias("__first"))
    return rows.withColumn("__p", part).join(first, "__p").withColumn(name, inner + F.col("__first") + 1).drop("__p", "__at", "__first")


def rank_channels(channels: Sequence[tuple[DataFrame, str, str, float]], key: str, least: float = 0.0) -> DataFrame:
    """key, channel, rank, weight of channels (records, score, channel, weight): the records of each that score above
    ``least`` in one order; ties by key. All channels are sorted together, by ranges."""
    parts = [df.where(F.col(score) > least).select(key, F.lit(name).alias("channel"), F.col(score).cast("double").alias("__s"), F.lit(float(weight)).alias("weight")) for df, score, name, weight in channels]
    rows = numbered(reduce(DataFrame.unionByName, parts), [F.asc("channel"), F.desc("__s"), F.asc(key)], "__n")
    first = rows.groupBy("channel").agg(F.min("__n").alias("__f"))
    return rows.join(first, "channel").select(key, "channel", (F.col("__n") - F.col("__f") + 1).alias("rank"), "weight")


def fuse_channels(channels: DataFrame, key: str, smoothing: int = SMOOTHING) -> DataFrame:
    """key, score, contributions by weighted reciprocal ranks over channel rows (key, channel, rank, weight)."""
    part = F.col("weight") / (smoothing + F.col("rank"))
    return channels.groupBy(key).agg(F.round(F.sum(part), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.round(part, 9).alias("part"))))).alias("contributions"))


def fuzzy(df: DataFrame, name: str, asked: str, least: float = 0.4, most_edits: int = 2) -> DataFrame:
    """``df`` with similarity of trigrams and edits to ``asked``, for names that are near by either measure."""
    mine, theirs = trigrams(F.lit(asked)), trigrams(F.col(name))
    shared = F.size(F.array_intersect(mine, theirs)) / F.size(F.array_union(mine, theirs))
    edits = F.levenshtein(F.lower(name), F.lit(asked.lower()))
    return df.withColumn("similarity", F.round(shared, 6)).withColumn("edits", edits).where((F.col("similarity") >= least) | (F.col("edits") <= most_edits))


def with_cosine(df: DataFrame, vector: str, query: DataFrame) -> DataFrame:
    """``df`` with the column similarity to the one vector ``q`` of the one-row table ``query``."""
    return df.crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("similarity", cosine(F.col(vector), F.col("q"))).drop("q")  # one row


def ledger_features(df: DataFrame, query: str, key: str, score: str, identity: str) -> DataFrame:
    """query, top1, top2, identity_hit (among the first three), confidence of each query's results."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    best = df.withColumn("rk", F.row_number().over(order)).where("rk <= 3")
    return best.groupBy(query).agg(F.max(F.when(F.col("rk") == 1, F.col(score))).alias("top1"), F.max(F.when(F.col("rk") == 2, F.col(score))).alias("top2"), F.max(F.col(identity).cast("int")).alias("identity_hit"))


def with_confidence(df: DataFrame) -> DataFrame:
    """``df`` (top1, top2, identity_hit, stale) with the column confidence."""
    return df.withColumn("confidence", F.round(confidence(F.col("top1"), F.col("top2"), F.col("identity_hit") > 0, F.col("stale") > 0), 6))


def ranking_quality(predicted: DataFrame, relevant: DataFrame, query: str, key: str, k: int = 10) -> DataFrame:
    """query, ndcg, mrr, recall at k. ``predicted`` has query, a list ``ids``; ``relevant`` has query, key.

    Gains are binary; a predicted id that stands twice counts at its first place. Queries without relevant
    records are left out, those without predictions have 0.
    """
    ranked = predicted.select(query, F.posexplode(F.slice("ids", 1, k)).alias("pos", key)).groupBy(query, key).agg(F.min("pos").alias("pos"))
    wanted = relevant.select(query, key).distinct()
    found = wanted.join(ranked, [query, key], "left")
    per = found.groupBy(query).agg(
        F.count("*").alias("n"), F.count("pos").alias("hits"), F.min("pos").alias("first"), F.sum(F.when(F.col("pos").isNotNull(), 1 / F.log2(F.col("pos") + 2))).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.select(query, F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"), F.round(zero(1 / (F.col("first") + 1)), 6).alias("mrr"), F.round(F.col("hits") / F.col("n"), 6).alias("recall"))


def fill_budget(df: DataFrame, group: str, order: Sequence[str], size: str, budget: int) -> DataFrame:
    """The first rows of each group, by the columns of ``order`` (with - before a number that falls), up to the first that
    takes the sum of their sizes over a budget. Sizes are whole numbers from 0.

    No more than ``budget`` rows with a size can fit, so the running sum sees the first of a group alone, which are
    picked before they meet; rows of size 0 are held against the row where the sum went over.
    """
    keys = [-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in order]
    at = F.struct(*(k.alias(f"o{i}") for i, k in enumerate(keys)))
    w = Window.partitionBy(group).orderBy(*keys)
    some = df.where(F.col(size) > 0).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= budget + 1).drop("__rn")
    upto = some.withColumn("__upto", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = upto.where(F.col("__upto") > budget).groupBy(group).agg(F.min(at).alias("__end"))
    free = df.where(F.col(size) == 0).join(over, group, "left").where(F.col("__end").isNull() | (at < F.col("__end")))
    return upto.where(F.col("__upto") <= budget).select(*df.columns).unionByName(free.select(*df.columns))


def pack_budget(ranked: DataFrame, group: str, key: str, file: str, score: str, size: str, budget: int, most_per_file: int = 3, decay: float = 0.5, chunk: int = 50_000) -> DataFrame:
    """group, place, key, effective score: what greedily fits a budget, with diversity.

    Items come by score; the n-th of a file counts decay^n; at most ``most_per_file`` come from a file; an
    item that does not fit is passed over. This is sequential, so a group is packed ``chunk`` rows at a time: its
    best rows that can still be placed, with those of the chunk before whose turn has not come. What is left of the
    budget, how many each file has and where the chunk ended go on to the next one; rows larger than what is left
    and files that are full drop out, which rules out no row that could be placed. Scores are not negative; nulls
    of score, size or key cannot be placed.
    """
    spark, kind = ranked.sparkSession, dict(ranked.dtypes)
    cuts = Cuts(spark)
    named = ranked.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(file).alias("f"), F.col(score).cast("double").alias("s"), F.col(size).cast("double").alias("z"))
    rest = cuts.cut(named.where(F.col("k").isNotNull() & (F.col("s") >= 0) & (F.col("z") <= budget)))
    shape = f"what string, g {kind[group]}, place int, k {kind[key]}, f {kind[file]}, s double, z double, n int, left double, last boolean"
    state = None
    found: list[DataFrame] = []
    order = Window.partitionBy("g").orderBy(F.desc("s"), "k")

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        left, placed, taken, at, out, items = float(budget), 0, {}, g["g"].iloc[0], [], []
        for what, k, f, s, z, n, had in zip(*(g[c].tolist() for c in ("what", "k", "f", "s", "z", "n", "left")), strict=True):
            if what == "state":
                left, placed = had, int(n)
            elif what == "file":
                taken[f] = int(n)
            else:
                items.append((-s, k, f, z, what))
        items.sort(key=lambda x: x[:2])
        fresh = [x for x in items if x[4] == "row"]
        more = len(fresh) >= chunk  # the group may have rows beyond this chunk
        floor = -fresh[-1][0] if more else -1.0
        queues: dict = {}
        for i, (s, k, f, z, _) in enumerate(items):
            queues.setdefault(f, deque()).append((i, k, -s, z))
        head = lambda f: (-(queues[f][0][2] * decay ** taken.get(f, 0)), queues[f][0][0])
        heap = [(*head(f), f) for f in queues if taken.get(f, 0) < most_per_file]  # places are unique, so files are not compared
        heapify(heap)
        while heap and -heap[0][0] >= floor:
            _, _, f = heappop(heap)
            _, k, s, z = queues[f].popleft()
            n = taken.get(f, 0)
            if z <= left:
                taken[f], left, placed = n + 1, left - z, placed + 1
                out.append(("placed", at, placed, k, f, s * decay**n, z, n, left, False))
            if queues[f] and taken.get(f, 0) < most_per_file:
                heappush(heap, (*head(f), f))
        if more:
            out.append(("state", at, placed, fresh[-1][1], None, -fresh[-1][0], 0.0, placed, left, True))
            out += [("file", at, 0, None, f, 0.0, 0.0, n, left, False) for f, n in taken.items()]
            for _, _, f in heap:
                sizes: dict = {}
                for _, k, s, z in queues[f]:  # behind as many of its file that are no larger, an item is never placed
                    if z <= left and sum(c for y, c in sizes.items() if y <= z) < most_per_file:
                        sizes[z] = sizes.get(z, 0) + 1
                        out.append(("wait", at, 0, k, f, s, z, 0, left, False))
        return pd.DataFrame(out, columns=["what", "g", "place", "k", "f", "s", "z", "n", "left", "last"])

    blank = lambda df: df.select(F.lit("row").alias("what"), "g", F.lit(0).alias("place"), "k", "f", "s", "z", F.lit(0).alias("n"), F.lit(0.0).alias("left"), F.lit(False).alias("last"))
    while True:
        best = blank(rest.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= chunk))
        given = best if state is None else best.unionByName(state)
        # few bytes, but work for all cores; as many parts as the window has would be taken for the same shuffle
        spread = given.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, "g")
        done = cuts.cut(spread.groupBy("g").applyInPandas(pack, shape))
        found.append(done.where("what = 'placed'").select(F.col("g").alias(group), "place", F.col("k").alias(key), F.col("s").alias("effective")))
        state = done.where("what <> 'placed'")
        ends = state.where("what = 'state'").select("g", F.col("s").alias("es"), F.col("k").alias("ek"), F.col("left").alias("el"))
        if ends.isEmpty():
            return reduce(DataFrame.unionByName, found)
        full = state.where((F.col("what") == "file") & (F.col("n") >= most_per_file)).select("g", "f")
        beyond = (F.col("s") < F.col("es")) | (F.col("s") == F.col("es")) & (F.col("k") > F.col("ek"))
        rest = cuts.cut(rest.join(ends, "g").where(beyond & (F.col("z") <= F.col("el"))).select("g", "k", "f", "s", "z").join(full, ["g", "f"], "left_anti"))


def best_per_file(df: DataFrame, file: str, order: Sequence[Column], most: int) -> DataFrame:
    """The ``most`` first rows of each file, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(file).orderBy(*order))).where(F.col("place") <= most)


def classify_intent(df: DataFrame, text: str, keywords: Mapping[str, Sequence[str]], default: str) -> DataFrame:
    """``df`` with intent and its confidence: keyword hits weigh 1 + length / 30; ties go by name."""
    low = F.lower(F.coalesce(text, F.lit("")))
    each = []
    for intent, words in sorted(keywords.items()):
        hits = [F.contains(low, F.lit(w)) for w in words]
        weight = sum((F.when(h, 1 + len(w) / 30).otherwise(0.0) for h, w in zip(hits, words, strict=True)), F.lit(0.0))
        count = sum((h.cast("int") for h in hits), F.lit(0))
        each.append(F.struct((-F.round(weight, 6)).alias("w"), F.lit(intent).alias("intent"), count.alias("n")))
    best = F.array_min(F.array(*each))
    none = best["w"] == 0
    return df.withColumn("intent", F.when(none, default).otherwise(best["intent"])).withColumn("intent_confidence", F.when(none, 0.0).otherwise(F.round(F.least(F.lit(0.95), 0.55 + 0.1 * best["n"]), 4)))


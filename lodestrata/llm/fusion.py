"""One ranking from several differently scaled scores, by reciprocal ranks.

Each channel ranks the candidates of a query on its own; a candidate gets 1 / (k + rank) from every
channel that scored it. Only ranks count, so no channel rules by its range. Ranking stands on counts of
higher scores, not on one sorted list: a query with a third of all candidates is cut into score ranges,
each ranked alone and moved on by the counts of the ranges above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cuts


def ranks(df: DataFrame, groups: Sequence[str], score: str, chunk: int = 100_000) -> DataFrame:
    """``df`` with the column rank: 1 + the number of rows of the group with a higher score.

    Groups of over ``chunk`` rows are cut at approximate quantiles of their scores, which are written down
    once, so that every reader of them sees the same ranges. Scores are neither null nor NaN.
    """
    g = list(groups)
    cuts = Cuts(df.sparkSession)
    sizes = df.groupBy(*g).agg(F.count("*").alias("__n")).where(F.col("__n") > chunk)
    big = cuts.cut(sizes)
    if big.isEmpty():
        return df.withColumn("rank", F.rank().over(Window.partitionBy(*g).orderBy(F.desc(score))).cast("bigint"))
    df = cuts.cut(df)
    pieces = max(2, int(big.agg(F.max("__n")).first()[0] / chunk) * 2)
    at = [i / pieces for i in range(1, pieces)]
    bounds = cuts.cut(df.join(big, g).groupBy(*g).agg(F.array_distinct(F.percentile_approx(score, at, 10 * pieces)).alias("__b")))
    cut = df.join(bounds, g, "left").withColumn("__r", F.coalesce(F.size(F.filter("__b", lambda b: b > F.col(score))), F.lit(0))).drop("__b")
    # equal scores share a row here, so ties do not make a range large
    counts = cut.groupBy(*g, "__r", score).agg(F.count("*").alias("__c"))
    inner = Window.partitionBy(*g, "__r").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*g).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    above = counts.groupBy(*g, "__r").agg(F.sum("__c").alias("__c")).withColumn("__o", F.coalesce(F.sum("__c").over(outer), F.lit(0))).drop("__c")
    placed = counts.withColumn("__i", F.coalesce(F.sum("__c").over(inner), F.lit(0))).join(above, [*g, "__r"])
    return cut.join(placed.select(*g, "__r", score, (F.col("__i") + F.col("__o") + 1).cast("bigint").alias("rank")), [*g, "__r", score]).drop("__r")


def channel_scores(df: DataFrame, query: str, item: str, scores: str) -> DataFrame:
    """query, item, channel, score of a map of scores. Null and NaN are no scores; repeated rows count once."""
    rows = df.where(F.col(query).isNotNull() & F.col(item).isNotNull()).select(F.col(query), F.col(item), F.explode(scores).alias("channel", "score"))
    return rows.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(query, item, "channel").agg(F.max("score").alias("score"))


def reciprocal_rank_fusion(df: DataFrame, query: str, item: str, scores: str, k: int = 60, chunk: int = 100_000) -> DataFrame:
    """query, item, fused, channels: the fused score of each candidate and how many channels scored it.

    Candidates that no channel scored get 0. Equal scores share a rank. Fused scores are rounded to 12
    places, so that the order of adding makes no difference.
    """
    ranked = ranks(channel_scores(df, query, item, scores), [query, "channel"], "score", chunk)
    fused = ranked.groupBy(query, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("fused"), F.count("*").alias("channels"))
    scored = F.exists(F.map_values(scores), lambda s: s.isNotNull() & ~F.isnan(s))
    none = df.where(F.col(query).isNotNull() & F.col(item).isNotNull() & ~F.coalesce(scored, F.lit(False))).select(query, item).distinct()
    empty = none.join(fused, [query, item], "left_anti").select(query, item, F.lit(0.0).alias("fused"), F.lit(0).cast("bigint").alias("channels"))
    return fused.unionByName(empty)


def best_per_query(fused: DataFrame, query: str, item: str) -> DataFrame:
    """query, item: the candidate with the highest fused score; on a tie the one with the smallest id."""
    return fused.groupBy(query).agg(F.min(F.struct((-F.col("fused")).alias("__s"), F.col(item))).alias("__m")).select(query, F.col(f"__m.{item}").alias(item))

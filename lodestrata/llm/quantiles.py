"""Exact percentiles per group by distributed multi-select.

Every block of rows, a partition or a day, proposes the median of what it still holds of a group. The
weighted median of the proposals is the group's next pivot. Each block then counts its values below, at
and above the pivot; that tells on which side each wanted rank lies, or that the pivot is it, and the
other side is ruled out. So rounds halve what is left, and a group is done when every rank is found.
What is left of a group once it fits easily in one task is ranked there.

Only counts and medians leave the blocks, so single days can be put together: a day needs to answer
medians and counts, not to hand over its values. The error bound is zero: the result is the value of rank
ceil(p n), whatever the blocks. A group with a third of all rows is spread over all its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cuts

PERCENTS = (0.5, 0.9, 0.95, 0.99)


def measured(value: Column) -> Column:
    """A measurement: null, NaN and negative values are none."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0)


def multi_select(
    df: DataFrame, groups: Sequence[str], value: str, block: Column | None = None, percents: Sequence[float] = PERCENTS, finish: int = 20_000
) -> DataFrame:
    """groups, n, percent, value: the value of rank ceil(percent n) among the n values of each group.

    ``block`` says which block a row belongs to, the partition where not given. Rows with a null group or
    a null or NaN value count nowhere. Equal values are as many values. An empty table gives no rows.
    """
    cuts = Cuts(df.sparkSession)
    g = list(groups)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    for c in g:
        rows = rows.where(F.col(c).isNotNull())
    if block is None:
        data = cuts.cut(rows.select(*g, F.col(value).cast("double").alias("v"))).withColumn("block", F.spark_partition_id())
    else:
        data = cuts.cut(rows.select(*g, F.col(value).cast("double").alias("v"), block.alias("block")))
    medians = data.groupBy(*g, "block").agg(F.count("*").alias("n"), F.percentile_approx("v", 0.5, 200).alias("m"))
    whole = medians.groupBy(*g).agg(F.sum("n").alias("n"), F.percentile("m", 0.5, F.col("n")).alias("pivot"))
    wanted = F.array(*(F.struct(F.lit(p).alias("percent"), F.ceil(F.lit(p) * F.col("n")).cast("bigint").alias("k")) for p in percents))
    state = cuts.cut(
        whole.select(*g, "n", F.lit(1).cast("decimal(38,0)").alias("seg"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), "pivot", F.col("n").alias("size"), wanted.alias("wanted"))
    )
    found: list[DataFrame] = []
    held = None
    while True:
        small, left = state.where(F.col("size") <= finish), state.where(F.col("size") > finish)
        sizes = state.agg(F.sum(F.when(F.col("size") > finish, F.col("size"))), F.sum("size")).first()
        if sizes[1]:
            found.append(cuts.cut(_finish(_inside(data, small, g), g)))
        if not sizes[0]:
            break
        if held is None or sizes[0] * 4 <= held:  # most rows are ruled out: go on with the rest alone
            if held is not None:
                data = cuts.cut(_inside(data, left, g).select(*g, "v", "block"))
            held = sizes[0]
        v, at = F.col("v"), F.col("pivot")
        counted = (
            _inside(data, left, g)
            .groupBy(*g, "seg", "block")
            .agg(
                F.count_if(v < at).alias("lt"),
                F.count_if(v == at).alias("eq"),
                F.count_if(v > at).alias("gt"),
                F.percentile_approx(F.when(v < at, v), 0.5, 200).alias("lm"),
                F.percentile_approx(F.when(v > at, v), 0.5, 200).alias("gm"),
            )
            .groupBy(*g, "seg")
            .agg(
                F.sum("lt").alias("lt"),
                F.sum("eq").alias("eq"),
                F.sum("gt").alias("gt"),
                F.percentile("lm", 0.5, F.col("lt")).alias("lp"),
                F.percentile("gm", 0.5, F.col("gt")).alias("gp"),
            )
        )
        turned = cuts.cut(left.join(counted, [*g, "seg"]).withColumn("w", F.explode("wanted")).drop("wanted"))
        k = F.col("w.k")
        found.append(turned.where((k > F.col("lt")) & (k <= F.col("lt") + F.col("eq"))).select(*g, "n", "w.percent", F.col("pivot").alias("value")))
        low = turned.where(k <= F.col("lt")).select(*g, "n", (F.col("seg") * 2).cast("decimal(38,0)").alias("seg"), "lo", F.col("pivot").alias("hi"), F.col("lp").alias("pivot"), F.col("lt").alias("size"), "w")
        high = turned.where(k > F.col("lt") + F.col("eq")).select(
            *g, "n", (F.col("seg") * 2 + 1).cast("decimal(38,0)").alias("seg"), F.col("pivot").alias("lo"), "hi", F.col("gp").alias("pivot"), F.col("gt").alias("size"), F.struct("w.percent", (k - F.col("lt") - F.col("eq")).alias("k")).alias("w")
        )
        again = low.unionByName(high).groupBy(*g, "n", "seg", "lo", "hi", "pivot", "size").agg(F.collect_list("w").alias("wanted"))
        state = cuts.cut(again)
    out = found[0] if found else None
    for part in found[1:]:
        out = out.unionByName(part)
    if out is None:
        return whole.select(*g, "n", F.lit(0.0).alias("percent"), F.col("pivot").alias("value")).limit(0)
    return out


def _inside(data: DataFrame, state: DataFrame, g: list[str]) -> DataFrame:
    """The rows that still count for a segment, each with that segment."""
    return data.join(state, g).where((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")))


def _finish(inside: DataFrame, g: list[str]) -> DataFrame:
    """The wanted ranks of small segments: equal values first become one row with a count."""
    keys = [*g, "n", "lo", "hi"]
    values = inside.groupBy(*keys, "v").agg(F.count("*").alias("c"), F.first("wanted").alias("wanted"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    ranked = values.withColumn("upto", upto).withColumn("w", F.explode("wanted"))
    return ranked.where((F.col("w.k") <= F.col("upto")) & (F.col("w.k") > F.col("upto") - F.col("c"))).select(*g, "n", "w.percent", F.col("v").alias("value"))

"""A mix of sources by target weights, scheduled fairly in proportion.

The mix is as large as the corpus, or as asked. Each source gives its target share, at most its tokens
times its allowed repeats; what capped and empty sources cannot give, the others share by weight. The mix
is cut into equal blocks. Block j of a source of weight w may not come before slot j / w and must be over
by slot (j + 1) / w; of the blocks that may come, the one due first is next. So at every point of the
mix each source is less than one block off its share.

A schedule has a bounded number of blocks whatever the data, as blocks grow with the mix, so the driver
makes it and it is broadcast.
Within a source documents follow a fixed random order; where a copy falls is a prefix sum over buckets of
that order, so the largest source is never sorted in one task.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cuts

#: Most blocks of a schedule, a bound on what the driver plans and broadcasts, and least tokens of a block.
BLOCKS, BLOCK_TOKENS = 20_000, 2_048


def fill_shares(shares: dict[str, float], capacity: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens of each source: its share of the budget, at most its capacity, the rest filled up by weight."""
    given = {s: 0.0 for s in shares}
    open_ = {s: w for s, w in shares.items() if w > 0 and capacity.get(s, 0) > 0}
    left = float(budget)
    while open_ and left > 1e-9 * budget:
        total = sum(open_.values())
        full = [s for s, w in open_.items() if given[s] + left * w / total >= capacity[s]]
        if not full:
            for s, w in open_.items():
                given[s] += left * w / total
            break
        for s in full:  # a full source drops out before the others are filled
            left -= capacity[s] - given[s]
            given[s] = float(capacity[s])
            del open_[s]
    return given


def pfair_schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """The order of the blocks, as (source, number of the block), by release times and earliest deadlines."""
    total = sum(blocks.values())
    ready: list[tuple[Fraction, str, int]] = []
    waiting = [(Fraction(0), s, 0) for s, n in sorted(blocks.items()) if n]
    heapq.heapify(waiting)
    order: list[tuple[str, int]] = []
    while waiting or ready:
        slot = len(order)
        while waiting and (waiting[0][0] <= slot or not ready):
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (Fraction((j + 1) * total, blocks[s]), s, j))
        _, s, j = heapq.heappop(ready)
        order.append((s, j))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (Fraction((j + 1) * total, blocks[s]), s, j + 1))
    return order


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, most_blocks: int = BLOCKS, block_tokens: int = BLOCK_TOKENS, seed: int = 7, bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, source, copy (from 1), slot, n_tokens of the mix of ``docs`` (doc_id, source, n_tokens).

    ``targets`` has source, target_share and max_repeats; a source with null or no share, documents of no
    target and documents without tokens stay out. ``budget`` is the number of tokens wanted, that of all
    documents of the sources where not given. Copies of a document within a source differ by one at most.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark)
    asked = {r["source"]: r for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = cuts.cut(docs.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull() & F.col("source").isin(list(asked))).select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"), order.alias("at")))
    sums = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    have = {s: int(sums[s]["t"]) for s in asked if s in sums}
    budget = int(budget if budget is not None else sum(have.values()))
    given = fill_shares({s: float(asked[s]["target_share"]) for s in have}, {s: have[s] * int(asked[s]["max_repeats"]) for s in have}, budget)
    total = sum(given.values()) or 1.0
    size = max(total / most_blocks, block_tokens)  # tokens a block
    count = {s: max(1, round(g / size)) for s, g in given.items() if g > 0}
    slots = [(s, j, i) for i, (s, j) in enumerate(pfair_schedule(count))]
    schedule = spark.createDataFrame(slots, "source string, block int, slot int")
    plan = spark.createDataFrame([(s, have[s], float(given[s]), count[s]) for s in count], "source string, have bigint, give double, blocks int")

    # where each document begins within its source, by buckets of the random order
    buckets = max(1, -(-max([r["n"] for r in sums.values()], default=1) // bucket_rows))
    placed = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("at", 1), F.lit(buckets)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("b")).withColumn("first", F.coalesce(F.sum("b").over(before), F.lit(0))).drop("b")
    inner = Window.partitionBy("source", "bucket").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(starts, ["source", "bucket"])
    begun = within.join(F.broadcast(plan), "source").withColumn("start", F.col("first") + F.col("inner"))
    # copy c begins at start + (c - 1) * have; it is in the mix while that is below what the source gives
    copies = F.ceil((F.col("give") - F.col("start")) / F.col("have")).cast("int")
    each = begun.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    block = F.least(F.col("blocks") - 1, F.floor((F.col("start") + (F.col("copy") - 1) * F.col("have")) / F.col("give") * F.col("blocks"))).cast("int")
    return each.withColumn("block", block).join(F.broadcast(schedule), ["source", "block"]).select("doc_id", "source", "copy", "slot", "n_tokens")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, mean and most repeats of every target; empty ones have 0."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.max("copy").alias("c"), F.sum("n_tokens").alias("t"))
    per = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("documents"), F.avg("c").alias("mean_repeats"), F.max("c").alias("most_repeats"))
    joined = targets.select("source", "target_share", "max_repeats").distinct().join(per, "source", "left")
    whole = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # one row a source
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "source", "target_share", F.round(zero("tokens") / whole, 6).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), "max_repeats",
        F.round(zero("mean_repeats"), 4).alias("mean_repeats"), zero("most_repeats").alias("most_repeats"),
    )

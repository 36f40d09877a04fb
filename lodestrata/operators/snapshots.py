"""Differences between snapshots, overlays, merges and rows kept by recency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The n first rows of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """keys, status: added, removed, changed or unchanged; rows are unique by keys, null keys match each other.

    A row differs where its content differs; null content equals null content.
    """
    a = old.groupBy(*keys).agg(F.min(F.struct(F.lit(1).alias("i"), F.col(content).alias("c"))).alias("a"))
    b = new.groupBy(*keys).agg(F.min(F.struct(F.lit(1).alias("i"), F.col(content).alias("c"))).alias("b"))
    both = a.select(*keys, "a", F.lit(None).cast(b.schema["b"].dataType).alias("b")).unionByName(b.select(*keys, F.lit(None).cast(a.schema["a"].dataType).alias("a"), "b"))
    one = both.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    status = F.when(F.col("a.i").isNull(), "added").when(F.col("b.i").isNull(), "removed").when(F.col("a.c").eqNullSafe(F.col("b.c")), "unchanged").otherwise("changed")
    return one.select(*keys, status.alias("status"))


def renames(diff: DataFrame, old: DataFrame, new: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """old_KEY, new_KEY of removed and added rows with one content that only one row of either side has."""
    side = lambda df, status, p: (
        df.join(diff.where(F.col("status") == status).select(*keys), list(keys), "left_semi")
        .where(F.col(content).isNotNull())
        .groupBy(F.col(content).alias("c"))
        .agg(F.count("*").alias("n"), *(F.min(k).alias(f"{p}_{k}") for k in keys))
        .where("n = 1")
        .drop("n")
    )
    return side(old, "removed", "old").join(side(new, "added", "new"), "c").drop("c")


def file_changes(old: DataFrame, new: DataFrame, key: str, mtime: str, digest: str) -> DataFrame:
    """key, status: new, deleted or changed. A file changed where both its time and its digest differ."""
    o = old.select(key, F.col(mtime).alias("om"), F.col(digest).alias("od"), F.lit(True).alias("o"))
    n = new.select(key, F.col(mtime).alias("nm"), F.col(digest).alias("nd"), F.lit(True).alias("n"))
    j = o.join(n, key, "full")
    changed = ~F.col("om").eqNullSafe(F.col("nm")) & ~F.col("od").eqNullSafe(F.col("nd"))
    return j.select(key, F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(changed, "changed").alias("status")).where("status is not null")


def overlay(base: DataFrame, delta: DataFrame, key: str, action: str) -> DataFrame:
    """``base`` without what ``delta`` deletes or modifies, with what it adds or modifies; in the columns of ``base``."""
    gone = delta.where(F.lower(action).isin("delete", "modify")).select(key)
    came = delta.where(F.lower(action).isin("add", "modify")).select(*base.columns)
    return base.join(gone, key, "left_anti").unionByName(came)


def carry_over(rows: DataFrame, before: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` with the value of before where they have none."""
    old = before.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("__old"))
    return rows.join(old, list(keys), "left").withColumn(value, F.coalesce(value, "__old")).drop("__old")


def subtree_merge(existing: DataFrame, fresh: DataFrame, path: str, prefix: str) -> DataFrame:
    """``existing`` with everything below a prefix replaced by ``fresh``."""
    return existing.where(~F.coalesce(F.col(path).startswith(prefix), F.lit(False))).unionByName(fresh.where(F.col(path).startswith(prefix)))


def replace_key(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of the keys of ``fresh`` replaced."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def keyed_upsert(state: DataFrame, batch: DataFrame, keys: Sequence[str], adds: Sequence[str], overwrites: Sequence[str], keeps: Sequence[str]) -> DataFrame:
    """``state`` merged with ``batch``, each one row a key: ``adds`` are summed, ``overwrites`` come from the batch
    where it has a value, ``keeps`` from the state where it has one. Null keys match each other."""
    cols = [*adds, *overwrites, *keeps]
    both = state.select(*keys, F.lit(0).alias("__new"), *cols).unionByName(batch.select(*keys, F.lit(1).alias("__new"), *cols))
    pick = lambda c, new: F.max(F.when(F.col("__new") == new, F.col(c)))
    return both.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in adds), *(F.coalesce(pick(c, 1), pick(c, 0)).alias(c) for c in overwrites), *(F.coalesce(pick(c, 0), pick(c, 1)).alias(c) for c in keeps)
    )


def newest(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The n newest rows of a table: what eviction leaves."""
    return df.orderBy(*order).limit(n)

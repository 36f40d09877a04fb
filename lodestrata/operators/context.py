"""What surrounds records: context of their files, pooled vectors, edits of names, budgets by strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import lines
from .ranking import pack_budget

STRATEGIES = ("most_relevant", "core_first", "compact")


def enrich(symbols: DataFrame, contexts: DataFrame, file: str = "file", keywords: str = "keywords") -> DataFrame:
    """``symbols`` with the tags of their files' contexts (file, tags) behind the keywords they have.

    Several contexts of a file count together; a tag that is a keyword already is not repeated, nulls are none.
    """
    tags = contexts.select(F.col("file").alias("__file"), F.explode("tags").alias("tag")).where("tag is not null").groupBy("__file").agg(F.array_sort(F.collect_set("tag")).alias("__tags"))
    none = F.array().cast("array<string>")
    joined = symbols.join(tags, F.col(file) == F.col("__file"), "left")
    return joined.withColumn(keywords, F.array_compact(F.array_union(F.coalesce(keywords, none), F.coalesce("__tags", none)))).drop("__file", "__tags")


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector: the mean of the vectors of each key, scaled to length one; a zero mean stays.

    Sums are made place by place, so a key with very many vectors is never gathered. Vectors of a key have one
    length; null and empty ones do not count.
    """
    places = df.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(key, F.posexplode(vector).alias("__at", "__x"))
    mean = places.groupBy(key, "__at").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    whole = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__m"))), lambda x: x["__m"]).alias("__v"))
    length = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.select(key, F.when(length > 0, F.transform("__v", lambda x: x / length)).otherwise(F.col("__v")).alias("vector"))


def rename_edits(texts: DataFrame, key: str, text: str, old: str, new: str) -> DataFrame:
    """key, line, before, after: the lines that hold a name as a whole word, and as they are with the new one."""
    if not old.isidentifier() or not new.isidentifier():
        raise ValueError("names are identifiers")
    word = rf"(?<![\w$]){old}(?![\w$])"
    rows = lines(texts.where(F.contains(F.col(text), F.lit(old))), key, text)
    return rows.where(F.col("text").rlike(word)).select(key, "line", F.col("text").alias("before"), F.regexp_replace("text", word, new).alias("after"))


def bundle(entries: DataFrame, group: str, key: str, size: str, centrality: str, first: Column, budget: int, strategy: str = "most_relevant") -> DataFrame:
    """group, place, key: what of each group's entries fits a budget, greedily with skips.

    'most_relevant' goes by centrality, 'core_first' takes the entries for which ``first`` holds before all others, and
    'compact' leaves sources out, so that each entry costs one.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategies are {', '.join(STRATEGIES)}")
    rank = F.coalesce(F.col(centrality).cast("double"), F.lit(0.0))
    score = F.when(first, rank + 1e9).otherwise(rank) if strategy == "core_first" else rank
    cost = F.lit(1) if strategy == "compact" else F.coalesce(size, F.lit(0))
    rows = entries.select(group, key, F.col(key).alias("__f"), score.alias("__s"), cost.alias("__z"))
    return pack_budget(rows, group, key, "__f", "__s", "__z", budget).select(group, "place", key)

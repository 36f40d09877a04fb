"""Filters and searches over records, lines, columns and paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import check_pattern, dirname, glob_regex

_NUMERIC = {"eq": "==", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "ne": "!="}
#: axis: how it is compared
AXES = {"set": ("eq", "in"), "text": ("eq", "matches"), "path": ("matches",), "number": tuple(_NUMERIC), "list": ("contains",), "prose": ("contains",)}


def criterion(column: str | Sequence[str], kind: str, op: str, value: Any) -> Column:
    """One condition. Null numbers count as 0, null lists and texts as empty; an operator the kind lacks is an error."""
    if kind not in AXES or op not in AXES[kind] or value is None:
        raise ValueError(f"no {op} on {kind}")
    many = [value] if isinstance(value, str) or not isinstance(value, Sequence) else list(value)
    if kind == "number":
        x = F.coalesce(F.col(column), F.lit(0))
        return {"==": x == value, ">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value, "!=": x != value}[_NUMERIC[op]]
    if kind == "list":
        holds = lambda e: reduce(Column.__or__, (F.contains(F.lower(e), F.lit(n.lower())) for n in many))
        return F.coalesce(F.exists(F.coalesce(column, F.array().cast("array<string>")), holds), F.lit(False))
    if kind == "prose":
        text = F.lower(F.concat_ws(" ", *([column] if isinstance(column, str) else column)))
        return F.contains(text, F.lit(str(value).lower()))
    x = F.coalesce(F.col(column), F.lit(""))
    if kind == "set":
        return x.isin(many)
    if kind == "path":
        return x.rlike(glob_regex(str(value)))
    return x == str(value) if op == "eq" else x.rlike(check_pattern(str(value)))


def winnow(df: DataFrame, criteria: Sequence[tuple[str | Sequence[str], str, str, Any]], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows that meet all criteria. They become one condition, so what can be pushed to the scan is."""
    return df.where(reduce(Column.__and__, (criterion(*c) for c in criteria), F.lit(True))).orderBy(*order).limit(k)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), text: the lines of texts; null texts have none."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def grep(df: DataFrame, key: str, text: str, query: str, context: int = 0, is_regex: bool = False) -> DataFrame:
    """key, line, text, before, after: lines that hold ``query`` whatever the case, with ``context`` lines around.

    The lines around come from the text's own array, so no line is joined or sorted.
    """
    parts = F.split(text, "\n")
    hit = (lambda x: x.rlike("(?i)" + check_pattern(query))) if is_regex else (lambda x: F.contains(F.lower(x), F.lit(query.lower())))
    rows = df.where(hit(F.col(text))) if not is_regex else df
    found = rows.select(key, parts.alias("all"), F.posexplode(parts).alias("at", "text")).where(hit(F.col("text")))
    before = F.slice("all", F.greatest(F.col("at") - context + 1, F.lit(1)), F.least(F.col("at"), F.lit(context)))
    after = F.slice("all", F.col("at") + 2, F.lit(context))
    return found.select(key, (F.col("at") + 1).alias("line"), "text", before.alias("before"), after.alias("after"))


def column_search(df: DataFrame, name: str, description: str, query: str) -> DataFrame:
    """``df`` with the column score, of columns whose name or description fits the query: whole name 30, part 15, 5 a
    word; description 8, 2 a word."""
    low, text = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    words = query.lower().split()
    has = lambda c, q: F.contains(c, F.lit(q))
    score = F.when(low == query.lower(), 30).when(has(low, query.lower()), 15).otherwise(0) + F.when(has(text, query.lower()), 8).otherwise(0)
    for w in words:
        score = score + F.when(has(low, w), 5).otherwise(0) + F.when(has(text, w), 2).otherwise(0)
    return df.withColumn("score", score).where("score > 0")


def flatten_columns(df: DataFrame, metadata: str) -> DataFrame:
    """provider, model, column, description of a nested map provider -> model -> column -> description."""
    a = df.select(F.explode(metadata).alias("provider", "models"))
    b = a.select("provider", F.explode("models").alias("model", "columns"))
    return b.select("provider", "model", F.explode("columns").alias("column", "description"))


def layer(path: Column, layers: Mapping[str, Sequence[str]]) -> Column:
    """The first layer one of whose prefixes the path begins with; null for none."""
    out = None
    for name, prefixes in layers.items():
        test = reduce(Column.__or__, (path.startswith(p) for p in prefixes))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def layer_violations(edges: DataFrame, src: Column, dst: Column | None, layers: Mapping[str, Sequence[str]], forbidden: Mapping[str, Sequence[str]]) -> DataFrame:
    """``edges`` with src_layer and dst_layer, where a layer uses one that it must not. Rules are part of the plan.

    Without ``dst`` the edges have dst_layer already.
    """
    rows = edges.withColumn("src_layer", layer(src, layers))
    rows = rows if dst is None else rows.withColumn("dst_layer", layer(dst, layers))
    bad = [(F.col("src_layer") == a) & F.col("dst_layer").isin(list(bs)) for a, bs in forbidden.items() if bs]
    return rows.where(reduce(Column.__or__, bad, F.lit(False)))


def stale_references(refs: DataFrame, ref: str, known: DataFrame, name: str, most_edits: int = 3) -> DataFrame:
    """ref, suggestion: references to names that do not exist, each with the nearest that does, if one is near.

    Names meet only where they share one of the most_edits + 1 parts that a name within so many edits keeps
    whole at nearly the same place, so no pair of all names is made and none within the bound is lost.
    """
    stale = refs.select(ref).where(F.col(ref).isNotNull()).distinct().join(known.select(F.col(name).alias(ref)), ref, "left_anti")
    parts = most_edits + 1
    names = known.select(name).where(F.col(name).isNotNull()).distinct()
    n = F.length(name)
    start = lambda i: F.floor(n * i / parts).cast("int")
    cut = names.select(name, n.alias("n"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.substring(F.lower(name), start(i) + 1, start(i + 1) - start(i)).alias("part"), start(i).alias("at")) for i in range(parts)))).alias("p")).select(name, "n", "p.i", "p.part", "p.at")
    # a stale name asks with every substring that could be part i of a known name of a length within the bound
    m = F.length(ref)
    asks = stale.select(ref, F.explode(F.sequence(F.greatest(m - most_edits, F.lit(1)), m + most_edits)).alias("n"))
    low = lambda i: F.floor(F.col("n") * i / parts).cast("int")
    each = asks.select(ref, "n", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), low(i).alias("at"), (low(i + 1) - low(i)).alias("len")) for i in range(parts)))).alias("p"))
    moved = each.select(ref, "n", "p.i", "p.len", F.explode(F.sequence(F.greatest(F.col("p.at") - most_edits, F.lit(0)), F.col("p.at") + most_edits)).alias("from")).select(ref, "n", "i", F.substring(F.lower(ref), F.col("from") + 1, F.col("len")).alias("part")).distinct()
    near = moved.join(cut, ["n", "i", "part"]).select(ref, name).distinct().withColumn("d", F.levenshtein(F.lower(ref), F.lower(name))).where(F.col("d") <= most_edits)
    best = near.groupBy(ref).agg(F.min(F.struct("d", name)).alias("b")).select(ref, F.col(f"b.{name}").alias("suggestion"), F.col("b.d").alias("edits"))
    return stale.join(best, ref, "left")


def duplicate_runs(a: DataFrame, b: DataFrame, key: str, least: int = 3) -> DataFrame:
    """key, first, last, length of runs of at least ``least`` lines of ``b`` (key, line, text) that all stand in ``a``."""
    known = a.select(F.xxhash64("text").alias("h"), "text").distinct()
    rows = b.withColumn("h", F.xxhash64("text")).join(known, ["h", "text"], "left_semi")
    island = F.col("line") - F.row_number().over(Window.partitionBy(key).orderBy("line"))
    runs = rows.withColumn("island", island).groupBy(key, "island").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= least).drop("island")


def tree_counts(paths: DataFrame, path: str, size: str) -> DataFrame:
    """dir, depth, files, bytes of every directory above the files, whatever its depth."""
    parts = F.split(dirname(F.col(path)), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))
    return paths.select(F.explode(ups).alias("u"), size).select("u.*", size).groupBy("dir", "depth").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def line_range(df: DataFrame, text: str, first: int, last: int) -> Column:
    """The lines first to last of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def byte_slice(text: Column, offset: Column, length: Column) -> Column:
    """The bytes [offset, offset + length) of a text as text."""
    return F.substring(F.encode(text, "utf-8"), offset.cast("int") + 1, length.cast("int")).cast("string")

"""Aggregates and composite scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp


def percentile_by_index(df: DataFrame, keys: Sequence[str], value: str, indexes: Mapping[str, Column]) -> DataFrame:
    """keys, n and a column for each index: the value at that place, from 0, of the sorted values of a key.

    An index is an expression of n, such as ``(n - 1) div 2``. Values get their place by window, not by list.
    """
    w = Window.partitionBy(*keys)
    placed = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == at, F.col(value))).alias(c) for c, at in indexes.items()))


def hotspot(complexity: Column, churn: Column) -> Column:
    """Complexity by the logarithm of churn."""
    return F.round(complexity * F.log1p(F.coalesce(churn, F.lit(0))), 4)


def axis_score(kind: str, x: Column, whole: Column | None = None) -> Column:
    """A measure as 0 to 100, 100 is best; null stays null, so the axis drops out of a mean.

    complexity: 100 up to 3, then 6 less each; dead: 4 less a percent; cycles: 5 less each; coupling: 200 less by
    the unstable share; gap: 1 less a percent; churn: by steps of the highest hotspot; coverage: as it is.
    """
    out = {
        "complexity": F.when(x <= 3, 100.0).otherwise(100 - 6 * (x - 3)),
        "dead": 100 - 4 * x,
        "cycles": F.when(x <= 0, 100.0).otherwise(100 - 5 * x),
        "coupling": F.when(whole <= 0, 100.0).otherwise(100 - 200 * x / whole) if whole is not None else x,
        "gap": 100 - x,
        "churn": F.when(x <= 0, 100.0).when(x < 100, 80.0).when(x < 500, 60.0).when(x < 1000, 40.0).when(x < 2000, 20.0).otherwise(0.0),
        "coverage": x,
    }[kind]
    return F.when(x.isNotNull(), clamp(out.cast("double"), 0.0, 100.0))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def radar(df: DataFrame, axes: Mapping[str, Column]) -> DataFrame:
    """``df`` with each axis rounded to 1, their mean as composite, and its grade; null axes drop out of the mean."""
    rows = df.withColumns({a: F.round(c, 1) for a, c in axes.items()})
    total = sum((F.coalesce(a, F.lit(0.0)) for a in axes), F.lit(0.0))
    count = sum((F.col(a).isNotNull().cast("int") for a in axes), F.lit(0))
    composite = F.round(F.when(count > 0, total / count), 1)
    return rows.withColumn("composite", composite).withColumn("grade", grade(F.col("composite")))


def radar_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], axes: Sequence[str], bar: float = 3.0) -> DataFrame:
    """keys, axis, delta, verdict of two radars; delta is null where one side lacks the axis."""
    long = lambda df: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in axes))).alias("x")).select(*keys, "x.*")
    j = long(before).withColumnRenamed("v", "b").join(long(after).withColumnRenamed("v", "a"), [*keys, "axis"], "full")
    delta = F.round(F.col("a") - F.col("b"), 1)
    return j.select(*keys, "axis", delta.alias("delta"), F.when(delta <= -bar, "regression").when(delta >= bar, "improvement").when(delta.isNotNull(), "same").alias("verdict"))


def squash(x: Column, scale: float) -> Column:
    """A count as 0 to 1 by its logarithm, 1 from ``scale`` on."""
    return clamp(F.log1p(x) / F.log1p(F.lit(float(scale))), 0.0, 1.0)


def tune_weight(df: DataFrame, flag: str, value: str, weight: float, least: int = 50, bar: float = 0.05, step: float = 0.05, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """n, with_flag, without_flag, weight: moved a step by which of two groups does better, if enough rows tell."""
    means = df.agg(F.count("*").alias("n"), F.avg(F.when(F.col(flag) > 0, F.col(value))).alias("a"), F.avg(F.when(F.coalesce(F.col(flag), F.lit(0)) == 0, F.col(value))).alias("b"))
    gap = F.col("a") - F.col("b")
    moved = F.when((F.col("n") >= least) & (gap >= bar), weight + step).when((F.col("n") >= least) & (gap <= -bar), weight - step).otherwise(F.lit(weight))
    return means.select("n", F.round("a", 6).alias("with_flag"), F.round("b", 6).alias("without_flag"), F.round(clamp(moved, low, high), 6).alias("weight"))


# Kinds of commit by what the subject says; the first that fits holds.
COMMIT_KINDS = (
    ("revert", r"^revert"),
    ("rename", r"\brename[ds]?\b|\bmove[ds]?\b"),
    ("bugfix", r"\bfix(?:e[ds])?\b|\bbug\b|\bpatch\b|\bhotfix\b|\bcorrect\b|\bresolve[ds]?\b"),
    ("perf", r"\bperf(?:ormance)?\b|\boptimiz[e]?\b|\bspeed\b|\bfaster\b|\bcache\b"),
    ("refactor", r"\brefactor\b|\bclean\s*up\b|\brestructur\b|\bsimplif\b|\bextract\b|\bdecompos\b"),
    ("test", r"\btest[s]?\b|\bspec[s]?\b|\bcoverage\b"),
    ("docs", r"\bdoc[s]?\b|\breadme\b|\bchangelog\b|\bcomment\b"),
    ("config", r"\bconfig\b|\bci\b|\bdocker\b|\byaml\b|\benv\b|\bdeps?\b|\bbump\b|\bupgrade\b"),
    ("feature", r"\badd[s]?\b|\bfeat(?:ure)?\b|\bimplement\b|\bintroduc\b|\bnew\b|\bsupport\b|\benable\b"),
)


def commit_kind(subject: Column) -> Column:
    out = None
    for kind, pattern in COMMIT_KINDS:
        test = subject.rlike("(?i)" + pattern)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("evolution")


# What counts as a branch of a function's body.
BRANCHES = r"\bif\b|\belif\b|\belse\b|\bfor\b|\bwhile\b|\bdo\b|\bexcept\b|\bcatch\b|\bfinally\b|\bcase\b|\bwhen\b|\band\b|\bor\b|\|\||&&|\?(?!:)"


def cyclomatic(body: Column) -> Column:
    """1 + the branches of a text, those in strings and comments as well."""
    return F.when(F.length(body) > 0, F.regexp_count(body, F.lit(BRANCHES)) + 1).otherwise(F.lit(0))


def bracket_depth(body: Column) -> Column:
    """The deepest nesting of brackets in a text; closing ones below zero stay at zero."""
    marks = F.split(F.regexp_replace(body, r"[^\[\](){}]+", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, c: Column) -> Column:
        d = F.when(c.isin("(", "[", "{"), acc["d"] + 1).when(c.isin(")", "]", "}"), F.greatest(acc["d"] - 1, F.lit(0))).otherwise(acc["d"])
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    return F.aggregate(marks, start, step, lambda acc: acc["m"])


def param_count(signature: Column) -> Column:
    """Parameters in the first brackets of a signature; brackets within them and void do not count."""
    inside = F.regexp_extract(signature, r"\(((?:[^()]|\([^()]*\))*)\)", 1)
    flat = F.regexp_replace(F.regexp_replace(inside, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", ""), r"<[^<>]*>", "")
    text = F.trim(flat)
    return F.when(text.isNull() | text.isin("", "void"), 0).otherwise(F.size(F.split(F.regexp_replace(text, r",\s*$", ""), ",")))

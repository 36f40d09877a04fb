"""Queries of aggregates, composite scores, snapshots and rows kept by recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import banded, clamp, cosine
from ..operators import metrics as M
from ..operators import snapshots as S
from ..session import Cuts
from ..tables import table
from .code import symbols
from .graphs import _CALLS, calls_by_name, symbol_uses
from .registry import Registry

REGISTRY = Registry()
_TEST = "regexp_matches('/' || {0}, '/(tests?|__tests__)/')"


def _is_test(c: str) -> Column:
    return F.concat(F.lit("/"), F.col(c)).rlike(r"/(?:tests?|__tests__)/")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls, repeated rows once."""
    return table(spark, sf_dir, "tool_calls").distinct()


@REGISTRY.query(
    "hotspots",
    """WITH s AS (SELECT DISTINCT id, file, cyclomatic FROM symbols WHERE cyclomatic >= 2), c AS (SELECT file, count(DISTINCT branch) AS churn FROM branch_deltas GROUP BY file)
SELECT id, round(cyclomatic * ln(1 + coalesce(churn, 0)), 4) AS score, CASE WHEN round(cyclomatic * ln(1 + coalesce(churn, 0)), 4) > 10 THEN 'high' WHEN round(cyclomatic * ln(1 + coalesce(churn, 0)), 4) > 3 THEN 'medium' ELSE 'low' END AS band
FROM s LEFT JOIN c USING (file) ORDER BY score DESC, id LIMIT 100""",
)
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 symbols with most complexity by churn."""
    churn = table(spark, sf_dir, "branch_deltas").groupBy("file").agg(F.count_distinct("branch").alias("churn"))
    rows = symbols(spark, sf_dir, "id", "file", "cyclomatic").where("cyclomatic >= 2").join(churn, "file", "left")
    scored = rows.select("id", M.hotspot(F.col("cyclomatic"), F.col("churn")).alias("score"))
    return scored.withColumn("band", banded(F.col("score"), [(10, "high"), (3, "medium")], "low")).orderBy(F.desc("score"), "id").limit(100)


@REGISTRY.query(
    "churn_stats",
    "WITH d AS (SELECT DISTINCT branch, file, action, file_mtime_ns FROM branch_deltas WHERE file IS NOT NULL) SELECT file, count(*) AS changes, count(DISTINCT branch) AS branches, string_agg(DISTINCT lower(action), ',' ORDER BY lower(action)) AS actions, min(file_mtime_ns) AS first_ns, max(file_mtime_ns) AS last_ns, CASE WHEN count(*) > 3 THEN 'high' WHEN count(*) > 1 THEN 'medium' ELSE 'low' END AS band FROM d GROUP BY file",
)
def churn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, on which branches and when each file changed."""
    d = table(spark, sf_dir, "branch_deltas").where("file is not null").select("branch", "file", "action", "file_mtime_ns").distinct()
    g = d.groupBy("file").agg(F.count("*").alias("changes"), F.count_distinct("branch").alias("branches"), F.array_join(F.array_sort(F.collect_set(F.lower("action"))), ",").alias("actions"), F.min("file_mtime_ns").alias("first_ns"), F.max("file_mtime_ns").alias("last_ns"))
    return g.withColumn("band", banded(F.col("changes"), [(3, "high"), (1, "medium")], "low"))


@REGISTRY.query("extraction_candidates", _CALLS + ", x AS (SELECT DISTINCT id, cyclomatic FROM symbols) SELECT id, files + (own > 0)::INT AS callers, cyclomatic * (files + (own > 0)::INT) AS score FROM uses JOIN x USING (id) WHERE cyclomatic >= 1 AND files + (own > 0)::INT >= 1")
def extraction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by complexity times the number of files that call them."""
    g = symbol_uses(spark, sf_dir).select("id", (F.col("files") + (F.col("own") > 0).cast("int")).alias("callers")).where("callers >= 1")
    x = symbols(spark, sf_dir, "id", "cyclomatic").where("cyclomatic >= 1")
    return g.join(x, "id").select("id", "callers", (F.col("cyclomatic") * F.col("callers")).alias("score"))


_HOT = """WITH r AS (SELECT DISTINCT * FROM runtime_calls WHERE symbol_id <> ''), s AS (SELECT DISTINCT id, file FROM symbols)
SELECT symbol_id, sum(count)::BIGINT AS hits, max(CASE WHEN p50_ms >= 0 AND NOT isnan(p50_ms) THEN p50_ms END) AS p50, max(CASE WHEN p95_ms >= 0 AND NOT isnan(p95_ms) THEN p95_ms END) AS p95, min(first_seen) AS first_seen, max(last_seen) AS last_seen, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM r JOIN s ON symbol_id = id GROUP BY symbol_id"""


@REGISTRY.query("hot_paths", _HOT + " ORDER BY hits DESC NULLS LAST, symbol_id LIMIT 200")
def hot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 symbols called most, with latencies, times and sources."""
    r = table(spark, sf_dir, "runtime_calls").where("symbol_id <> ''").distinct()
    ok = lambda c: F.max(F.when((F.col(c) >= 0) & ~F.isnan(c), F.col(c)))
    g = r.groupBy("symbol_id").agg(F.sum("count").alias("hits"), ok("p50_ms").alias("p50"), ok("p95_ms").alias("p95"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    known = table(spark, sf_dir, "symbols").select(F.col("id").alias("symbol_id"))
    return g.join(known, "symbol_id", "left_semi").orderBy(F.desc_nulls_last("hits"), "symbol_id").limit(200)


@REGISTRY.query(
    "unused_paths",
    f"""WITH s AS (SELECT DISTINCT id, file FROM symbols WHERE NOT {_TEST.format("file")}), r AS (SELECT symbol_id, max(left(last_seen, 19)) AS seen FROM runtime_calls WHERE symbol_id <> '' GROUP BY symbol_id)
SELECT id, seen FROM s LEFT JOIN r ON id = symbol_id WHERE seen IS NULL OR seen < '2024-09-01'""",
)
def unused_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols outside tests that were not seen to run since a day."""
    r = table(spark, sf_dir, "runtime_calls").where("symbol_id <> ''").groupBy(F.col("symbol_id").alias("id")).agg(F.max(F.left("last_seen", F.lit(19))).alias("seen"))
    return symbols(spark, sf_dir, "id", "file").where(~_is_test("file")).join(r, "id", "left").select("id", "seen").where("seen is null or seen < '2024-09-01'")


@REGISTRY.query(
    "runtime_coverage",
    """WITH s AS (SELECT DISTINCT id, split_part(file, '/', 1) AS repo FROM symbols), c AS (SELECT DISTINCT symbol_id FROM runtime_calls)
SELECT repo, count(*) AS symbols, count(symbol_id) AS confirmed, round(100e0 * count(symbol_id) / count(*), 2) AS pct FROM s LEFT JOIN c ON id = symbol_id GROUP BY repo""",
)
def runtime_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols of each repository were seen to run."""
    s = symbols(spark, sf_dir, "id", "file").select("id", F.substring_index("file", "/", 1).alias("repo"))
    c = table(spark, sf_dir, "runtime_calls").select(F.col("symbol_id").alias("id"), F.lit(1).alias("hit")).distinct()
    g = s.join(c, "id", "left").groupBy("repo").agg(F.count("*").alias("symbols"), F.count("hit").alias("confirmed"))
    return g.withColumn("pct", F.round(100 * F.col("confirmed") / F.col("symbols"), 2))


@REGISTRY.query(
    "dead_code",
    _CALLS + f""", al AS (SELECT file FROM uses GROUP BY file HAVING max(files) > 0), ua AS (SELECT repo, name, count(*) AS alive FROM us WHERE src IN (SELECT file FROM al) GROUP BY ALL),
u AS (SELECT file, max(files) AS files, max(files - tests) AS others, max(coalesce(alive, 0) - (own > 0)::INT) AS alive FROM uses LEFT JOIN ua ON split_part(file, '/', 1) = repo AND uses.name = ua.name WHERE files > 0 GROUP BY file), f AS (SELECT DISTINCT file FROM s)
SELECT f.file, CASE WHEN u.file IS NULL THEN 1.0e0 WHEN others = 0 THEN 0.9e0 ELSE 0.7e0 END AS confidence FROM f LEFT JOIN u USING (file) WHERE u.file IS NULL OR others = 0 OR alive = 0""",
)
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nothing calls into, only tests do, or only files that nothing calls into."""
    used = Cuts(spark).cut(symbol_uses(spark, sf_dir).where("files > 0").withColumn("repo", F.substring_index("file", "/", 1)))
    alive = used.select(F.col("file").alias("src")).distinct()
    by_alive = calls_by_name(spark, sf_dir).select("repo", "name", "src").distinct().join(alive, "src", "left_semi").groupBy("repo", "name").agg(F.count("*").alias("alive"))
    rows = used.join(by_alive, ["repo", "name"], "left")
    u = rows.groupBy("file").agg(F.max(F.col("files") - F.col("tests")).alias("others"), F.max(F.coalesce("alive", F.lit(0)) - (F.col("own") > 0).cast("int")).alias("alive"))
    files = table(spark, sf_dir, "symbols").select("file").distinct().join(u, "file", "left")
    conf = F.when(F.col("others").isNull(), 1.0).when(F.col("others") == 0, 0.9).otherwise(0.7)
    return files.where("others is null or others = 0 or alive = 0").select("file", conf.alias("confidence"))


_SIGNALS = _CALLS + f""", x AS (SELECT DISTINCT id, file FROM symbols WHERE lower(kind) IN ('function', 'method') AND NOT {_TEST.format("file")}),
cf AS (SELECT DISTINCT file FROM uses WHERE files > 0), cc AS (SELECT DISTINCT id FROM uses WHERE files + own > 0), rt AS (SELECT DISTINCT symbol_id FROM runtime_calls WHERE symbol_id <> ''),
g AS (SELECT id, file, ((file NOT IN (SELECT file FROM cf))::INT + (id NOT IN (SELECT id FROM cc))::INT + (id NOT IN (SELECT symbol_id FROM rt))::INT) AS signals FROM x)
"""


@REGISTRY.query("dead_code_signals", _SIGNALS + "SELECT id, signals, round(signals / 3e0, 4) AS confidence FROM g WHERE signals >= 2")
def dead_code_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that at least two of three signals call dead: no file uses theirs, nothing calls them, they never ran."""
    x = symbols(spark, sf_dir, "id", "file", "kind").where(F.lower("kind").isin("function", "method") & ~_is_test("file")).select("id", "file").distinct()
    u = Cuts(spark).cut(symbol_uses(spark, sf_dir).where("files + own > 0").select("id", "file", "files"))
    mark = lambda df, c: df.distinct().withColumn(c, F.lit(1))
    j = (
        x.join(mark(u.where("files > 0").select("file"), "a"), "file", "left")
        .join(mark(u.select("id"), "b"), "id", "left")
        .join(mark(table(spark, sf_dir, "runtime_calls").where("symbol_id <> ''").select(F.col("symbol_id").alias("id")), "c"), "id", "left")
    )
    signals = sum((F.col(c).isNull().cast("int") for c in "abc"), F.lit(0))
    return j.select("id", signals.alias("signals")).where("signals >= 2").withColumn("confidence", F.round(F.col("signals") / 3, 4))


@REGISTRY.query("uncalled_names", "WITH c AS (SELECT DISTINCT unnest(call_references) AS name FROM symbols) SELECT DISTINCT id, 0.5e0 AS confidence FROM symbols WHERE lower(kind) IN ('function', 'method') AND name IS NOT NULL AND name NOT IN (SELECT name FROM c WHERE name IS NOT NULL)")
def uncalled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose name nothing calls anywhere."""
    rows = table(spark, sf_dir, "symbols")
    called = rows.select(F.explode("call_references").alias("name"))
    mine = rows.where(F.lower("kind").isin("function", "method") & F.col("name").isNotNull()).select("id", "name").distinct()
    return mine.join(called, "name", "left_anti").select("id", F.lit(0.5).alias("confidence")).distinct()


@REGISTRY.query(
    "untested_symbols",
    _CALLS + f""", x AS (SELECT DISTINCT id, file FROM symbols WHERE lower(kind) IN ('function', 'method') AND NOT {_TEST.format("file")})
SELECT id, CASE WHEN file IN (SELECT file FROM uses WHERE all_tests > 0) THEN 0.7e0 ELSE 1.0e0 END AS confidence FROM x WHERE id NOT IN (SELECT id FROM uses WHERE all_tests > 0)""",
)
def untested_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that no test calls: surely where no test uses their file, else probably."""
    x = symbols(spark, sf_dir, "id", "file", "kind").where(F.lower("kind").isin("function", "method") & ~_is_test("file")).select("id", "file").distinct()
    t = Cuts(spark).cut(symbol_uses(spark, sf_dir).where("all_tests > 0").select("id", "file"))
    j = x.join(t.select("id"), "id", "left_anti").join(t.select("file", F.lit(1).alias("h")).distinct(), "file", "left")
    return j.select("id", F.when(F.col("h").isNotNull(), 0.7).otherwise(1.0).alias("confidence"))


_RADAR = """WITH s AS (SELECT DISTINCT id, file, kind, cyclomatic, split_part(file, '/', 1) AS repo FROM symbols), r AS (SELECT DISTINCT symbol_id FROM runtime_calls WHERE symbol_id <> ''),
a AS (SELECT repo, avg(cyclomatic) FILTER (lower(kind) IN ('function', 'method') AND cyclomatic > 0) AS cx, 100e0 * count(*) FILTER (symbol_id IS NULL AND lower(kind) IN ('function', 'method')) / nullif(count(*) FILTER (lower(kind) IN ('function', 'method')), 0) AS gap,
  100e0 * count(symbol_id) / count(*) AS cov FROM s LEFT JOIN r ON id = symbol_id GROUP BY repo),
x AS (SELECT repo, round(CASE WHEN cx IS NULL THEN NULL WHEN cx <= 3 THEN 100e0 ELSE greatest(0e0, least(100e0, 100 - 6 * (cx - 3))) END, 1) AS complexity, round(greatest(0e0, least(100e0, 100 - gap)), 1) AS gap, round(greatest(0e0, least(100e0, cov)), 1) AS coverage FROM a),
m AS (SELECT *, round((coalesce(complexity, 0) + coalesce(gap, 0) + coalesce(coverage, 0)) / ((complexity IS NOT NULL)::INT + (gap IS NOT NULL)::INT + (coverage IS NOT NULL)::INT), 1) AS composite FROM x)
"""


def _radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir, "id", "file", "kind", "cyclomatic").withColumn("repo", F.substring_index("file", "/", 1))
    r = table(spark, sf_dir, "runtime_calls").where("symbol_id <> ''").select(F.col("symbol_id").alias("id"), F.lit(1).alias("hit")).distinct()
    fn = F.lower("kind").isin("function", "method")
    a = s.join(r, "id", "left").groupBy("repo").agg(
        F.avg(F.when(fn & (F.col("cyclomatic") > 0), F.col("cyclomatic"))).alias("cx"),
        (F.lit(100.0) * F.count_if(fn & F.col("hit").isNull()) / F.when(F.count_if(fn) > 0, F.count_if(fn))).alias("gp"),
        (F.lit(100.0) * F.count("hit") / F.count("*")).alias("cov"),
    )
    return M.radar(a, {"complexity": M.axis_score("complexity", F.col("cx")), "gap": M.axis_score("gap", F.col("gp")), "coverage": M.axis_score("coverage", F.col("cov"))})


@REGISTRY.query("health_radar", _RADAR + "SELECT repo, complexity, gap, coverage, composite, CASE WHEN composite >= 90 THEN 'A' WHEN composite >= 80 THEN 'B' WHEN composite >= 70 THEN 'C' WHEN composite >= 60 THEN 'D' ELSE 'F' END AS grade FROM m")
def health_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes from 0 to 100, their mean and a grade for each repository."""
    return _radar(spark, sf_dir).select("repo", "complexity", "gap", "coverage", "composite", "grade")


@REGISTRY.query(
    "radar_diff",
    _RADAR + """, z AS (SELECT avg(complexity) AS complexity, avg(gap) AS gap, avg(coverage) AS coverage FROM m),
d AS (SELECT repo, unnest(['complexity', 'gap', 'coverage']) AS axis, unnest([round(m.complexity - z.complexity, 1) + 0e0, round(m.gap - z.gap, 1) + 0e0, round(m.coverage - z.coverage, 1) + 0e0]) AS delta FROM m, z)
SELECT repo, axis, delta, CASE WHEN delta <= -3 THEN 'regression' WHEN delta >= 3 THEN 'improvement' WHEN delta IS NOT NULL THEN 'same' END AS verdict FROM d""",
)
def radar_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's axes against the mean of all."""
    now = _radar(spark, sf_dir)
    mean = now.agg(*(F.avg(a).alias(a) for a in ("complexity", "gap", "coverage")))
    base = now.select("repo").crossJoin(F.broadcast(mean))  # one row
    return M.radar_diff(base, now, ["repo"], ["complexity", "gap", "coverage"])


@REGISTRY.query(
    "file_risk",
    _CALLS + f""", x AS (SELECT file, max(cyclomatic) AS cx FROM symbols GROUP BY file), i AS (SELECT file, sum(files) AS n, max(tests) > 0 AS t FROM (SELECT DISTINCT file, name, files, tests FROM uses) GROUP BY file),
c AS (SELECT file, count(DISTINCT branch) AS churn FROM branch_deltas GROUP BY file),
p AS (SELECT x.file, greatest(0e0, least(100e0, 100 - 6 * greatest(coalesce(cx, 0) - 3, 0))) AS a, greatest(0e0, 100 - 5 * coalesce(n, 0)) AS b, greatest(0e0, 100 - 10 * coalesce(churn, 0)) AS c, CASE WHEN t THEN 100e0 ELSE 0e0 END AS d FROM x LEFT JOIN i USING (file) LEFT JOIN c USING (file))
SELECT file, round((a + b + c + d) / 4, 1) AS composite, CASE WHEN round((a + b + c + d) / 4, 1) >= 85 THEN 'low' WHEN round((a + b + c + d) / 4, 1) >= 70 THEN 'moderate' WHEN round((a + b + c + d) / 4, 1) >= 55 THEN 'high' ELSE 'critical' END AS level FROM p""",
)
def file_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of what complexity, use, churn and missing tests leave of 100, and its band."""
    x = table(spark, sf_dir, "symbols").groupBy("file").agg(F.max("cyclomatic").alias("cx"))
    i = symbol_uses(spark, sf_dir).select("file", "name", "files", "tests").distinct().groupBy("file").agg(F.sum("files").alias("n"), (F.max("tests") > 0).alias("t"))
    c = table(spark, sf_dir, "branch_deltas").groupBy("file").agg(F.count_distinct("branch").alias("churn"))
    zero = lambda col: F.coalesce(col, F.lit(0))
    a = clamp(100.0 - 6 * F.greatest(zero("cx") - 3, F.lit(0)), 0.0, 100.0)
    parts = [a, F.greatest(F.lit(0.0), 100.0 - 5 * zero("n")), F.greatest(F.lit(0.0), 100.0 - 10 * zero("churn")), F.when(F.col("t"), 100.0).otherwise(0.0)]
    j = x.join(i, "file", "left").join(c, "file", "left").select("file", F.round(sum(parts[1:], parts[0]) / 4, 1).alias("composite"))
    s = F.col("composite")
    return j.withColumn("level", F.when(s >= 85, "low").when(s >= 70, "moderate").when(s >= 55, "high").otherwise("critical"))


@REGISTRY.query(
    "change_risk",
    _CALLS + f""", d AS (SELECT DISTINCT branch, file FROM branch_deltas), x AS (SELECT file, max(cyclomatic) AS cx FROM symbols GROUP BY file), u AS (SELECT DISTINCT file FROM uses WHERE files > 0), t AS (SELECT DISTINCT file FROM uses WHERE all_tests > 0),
h AS (SELECT file, count(DISTINCT branch) AS churn FROM branch_deltas GROUP BY file),
g AS (SELECT branch, count(*) AS files, avg((u.file IS NOT NULL)::INT) AS blast, max(coalesce(cx, 0)) AS cx, avg(churn) AS churn, avg((t.file IS NULL)::INT) AS untested FROM d LEFT JOIN x USING (file) LEFT JOIN u USING (file) LEFT JOIN t USING (file) LEFT JOIN h USING (file) GROUP BY branch)
SELECT branch, round(0.30e0 * (1 - exp(-5 * blast)) + 0.25e0 * least(1e0, ln(1 + cx) / ln(31e0)) + 0.15e0 * least(1e0, ln(1 + churn) / ln(26e0)) + 0.20e0 * untested + 0.10e0 * least(1e0, ln(1 + files) / ln(61e0)), 6) AS risk FROM g""",
)
def change_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each branch: what its files reach, their complexity, churn, missing tests and number."""
    deltas = table(spark, sf_dir, "branch_deltas").select("branch", "file").distinct()
    x = table(spark, sf_dir, "symbols").groupBy("file").agg(F.max("cyclomatic").alias("cx"))
    flag = lambda c: F.when(F.max(c) > 0, 1)
    u = symbol_uses(spark, sf_dir).groupBy("file").agg(flag("files").alias("used"), flag("all_tests").alias("tested"))
    h = deltas.groupBy("file").agg(F.count("*").alias("churn"))
    j = deltas.join(x, "file", "left").join(u, "file", "left").join(h, "file", "left")
    g = j.groupBy("branch").agg(F.count("*").alias("files"), F.avg(F.col("used").isNotNull().cast("int")).alias("blast"), F.max(F.coalesce("cx", F.lit(0))).alias("cx"), F.avg("churn").alias("churn"), F.avg(F.col("tested").isNull().cast("int")).alias("untested"))
    risk = 0.30 * (1 - F.exp(-5 * F.col("blast"))) + 0.25 * M.squash(F.col("cx"), 30) + 0.15 * M.squash(F.col("churn"), 25) + 0.20 * F.col("untested") + 0.10 * M.squash(F.col("files"), 60)
    return g.select("branch", F.round(risk, 6).alias("risk"))


_SUBJECTS = "SELECT DISTINCT doc_id, split_part(text, chr(10), 1) AS subject FROM documents WHERE source = 'commit' AND text IS NOT NULL"


@REGISTRY.query("commit_kinds", f"WITH c AS ({_SUBJECTS}) SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(subject, '(?i){p}') THEN '{k}'" for k, p in M.COMMIT_KINDS) + " ELSE 'evolution' END AS kind FROM c) GROUP BY kind")
def commit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits by what their subject says they are."""
    docs = table(spark, sf_dir, "documents").where("source = 'commit' and text is not null").select("doc_id", F.substring_index("text", "\n", 1).alias("subject")).distinct()
    return docs.groupBy(M.commit_kind(F.col("subject")).alias("kind")).agg(F.count("*").alias("n"))


_OK = "SELECT DISTINCT * FROM tool_calls WHERE duration_ms >= 0 AND NOT isnan(duration_ms) AND tool IS NOT NULL"


@REGISTRY.query(
    "tool_latency",
    f"""WITH c AS ({_OK}), o AS (SELECT tool, duration_ms, ok, row_number() OVER (PARTITION BY tool ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY tool) AS n FROM c)
SELECT tool, max(n) AS n, max(CASE WHEN i = (n - 1) // 2 THEN duration_ms END) AS p50, max(CASE WHEN i = round_even(0.95e0 * (n - 1), 0) THEN duration_ms END) AS p95, max(duration_ms) AS slowest, round(1 - avg(CASE WHEN ok > 0 THEN 1e0 ELSE 0e0 END), 6) AS error_rate FROM o GROUP BY tool""",
)
def tool_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, nearest-rank median and 95th percentile, maximum and error rate of each tool."""
    rows = calls(spark, sf_dir).where("duration_ms >= 0 and not isnan(duration_ms) and tool is not null")
    p = M.percentile_by_index(rows, ["tool"], "duration_ms", {"p50": F.expr("(n - 1) div 2"), "p95": F.bround(0.95 * (F.col("n") - 1), 0)})
    g = rows.groupBy("tool").agg(F.max("duration_ms").alias("slowest"), F.round(1 - F.avg(F.when(F.col("ok") > 0, 1.0).otherwise(0.0)), 6).alias("error_rate"))
    return p.join(g, "tool").select("tool", "n", "p50", "p95", "slowest", "error_rate")


@REGISTRY.query(
    "latency_ring",
    f"""WITH c AS ({_OK}), r AS (SELECT tool, duration_ms FROM c QUALIFY row_number() OVER (PARTITION BY tool ORDER BY ts DESC, call_id DESC) <= 512),
o AS (SELECT tool, duration_ms, row_number() OVER (PARTITION BY tool ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY tool) AS n FROM r)
SELECT tool, max(n) AS n, max(CASE WHEN i = n // 2 THEN duration_ms END) AS p50, max(CASE WHEN i = least(floor(0.95e0 * n), n - 1) THEN duration_ms END) AS p95 FROM o GROUP BY tool""",
)
def latency_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the last 512 calls of each tool."""
    rows = calls(spark, sf_dir).where("duration_ms >= 0 and not isnan(duration_ms) and tool is not null")
    ring = S.first_per_key(rows, ["tool"], [F.desc("ts"), F.desc("call_id")], 512)
    n = F.col("n")
    return M.percentile_by_index(ring, ["tool"], "duration_ms", {"p50": F.expr("n div 2"), "p95": F.least(F.floor(0.95 * n), n - 1)})


@REGISTRY.query("cache_rollup", "SELECT tool, count(*) AS calls, count(*) FILTER (ok > 0) AS hits, round(count(*) FILTER (ok > 0) / count(*), 6) AS rate FROM (SELECT DISTINCT * FROM tool_calls) GROUP BY ROLLUP (tool)")
def cache_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and successes per tool and in all."""
    return calls(spark, sf_dir).rollup("tool").agg(F.count("*").alias("calls"), F.count_if(F.col("ok") > 0).alias("hits"), F.round(F.count_if(F.col("ok") > 0) / F.count("*"), 6).alias("rate"))


@REGISTRY.query("ledger_summary", "SELECT repo, count(*) AS events, round(avg(confidence) FILTER (NOT isnan(confidence)), 9) AS confidence, count(*) FILTER (repo_is_stale > 0) AS stale, count(*) FILTER (identity_hit > 0) AS identity, count(*) FILTER (semantic_used > 0) AS semantic FROM (SELECT DISTINCT * FROM ranking_events) GROUP BY repo")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking events of each repository and what was noted with them."""
    e = table(spark, sf_dir, "ranking_events").distinct()
    yes = lambda c: F.count_if(F.col(c) > 0)
    return e.groupBy("repo").agg(F.count("*").alias("events"), F.round(F.avg(F.when(~F.isnan("confidence"), F.col("confidence"))), 9).alias("confidence"), yes("repo_is_stale").alias("stale"), yes("identity_hit").alias("identity"), yes("semantic_used").alias("semantic"))


_HALF = "WITH c AS ({ok}), m AS (SELECT median(ts) AS t FROM c), a AS (SELECT tool, avg(duration_ms) AS v FROM c, m WHERE ts < t GROUP BY tool), b AS (SELECT tool, avg(duration_ms) AS v FROM c, m WHERE ts >= t GROUP BY tool)"


@REGISTRY.query("baseline_diff", _HALF.format(ok=_OK) + " SELECT coalesce(a.tool, b.tool) AS tool, round(b.v - a.v, 6) AS delta FROM a FULL JOIN b ON a.tool = b.tool")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean duration of each tool in the later half of the time against the earlier."""
    rows = calls(spark, sf_dir).where("duration_ms >= 0 and not isnan(duration_ms) and tool is not null")
    at = rows.agg(F.percentile("ts", 0.5).alias("t"))
    j = rows.crossJoin(F.broadcast(at))  # one row
    g = j.groupBy("tool").agg(F.avg(F.when(F.col("ts") < F.col("t"), F.col("duration_ms"))).alias("a"), F.avg(F.when(F.col("ts") >= F.col("t"), F.col("duration_ms"))).alias("b"))
    return g.select("tool", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@REGISTRY.query("weight_tuning", "WITH e AS (SELECT DISTINCT * FROM ranking_events WHERE confidence IS NOT NULL AND NOT isnan(confidence)), m AS (SELECT count(*) AS n, avg(confidence) FILTER (semantic_used > 0) AS a, avg(confidence) FILTER (coalesce(semantic_used, 0) = 0) AS b FROM e) SELECT n, round(a, 6) AS with_flag, round(b, 6) AS without_flag, round(greatest(0e0, least(1e0, CASE WHEN n >= 50 AND a - b >= 0.05 THEN 0.55e0 WHEN n >= 50 AND a - b <= -0.05 THEN 0.45e0 ELSE 0.5e0 END)), 6) AS weight FROM m")
def weight_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the weight of semantic search should move to, by the confidence with and without it."""
    e = table(spark, sf_dir, "ranking_events").where("confidence is not null and not isnan(confidence)").distinct()
    return M.tune_weight(e, "semantic_used", "confidence", 0.5)


@REGISTRY.query(
    "embedding_drift",
    """WITH e AS (SELECT symbol_id, embedding::DOUBLE[] AS v, embedded_at FROM symbol_embeddings WHERE symbol_id <> '' AND len(embedding) = 16 AND embedded_at IS NOT NULL),
p AS (SELECT symbol_id, arg_min(v, embedded_at) AS a, arg_max(v, embedded_at) AS b FROM e GROUP BY symbol_id HAVING count(DISTINCT embedded_at) > 1),
d AS (SELECT 1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS d FROM p)
SELECT count(*) AS pairs, round(max(d), 5) AS worst, round(avg(d), 5) AS mean, max(d) > 0.05 AS alarm FROM d""",
)
def embedding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the newest vector of a symbol lies from its oldest."""
    e = table(spark, sf_dir, "symbol_embeddings").where("symbol_id <> '' and size(embedding) = 16 and embedded_at is not null")
    p = e.groupBy("symbol_id").agg(F.min_by("embedding", "embedded_at").alias("a"), F.max_by("embedding", "embedded_at").alias("b"), F.count_distinct("embedded_at").alias("n")).where("n > 1")
    d = p.select((1 - cosine(F.col("a"), F.col("b"))).alias("d"))
    return d.agg(F.count("*").alias("pairs"), F.round(F.max("d"), 5).alias("worst"), F.round(F.avg("d"), 5).alias("mean"), (F.max("d") > 0.05).alias("alarm"))


@REGISTRY.query("language_counts", "SELECT lower(language) AS language, count(DISTINCT path) AS files FROM files WHERE language IS NOT NULL GROUP BY 1")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each language, however it is spelt."""
    return table(spark, sf_dir, "files").where("language is not null").groupBy(F.lower("language").alias("language")).agg(F.count_distinct("path").alias("files"))


@REGISTRY.query("saved_bytes", "WITH s AS (SELECT DISTINCT id, file, byte_length FROM symbols), f AS (SELECT path, max(size_bytes) AS size FROM files GROUP BY path) SELECT file, greatest(0, (max(size) - sum(byte_length)) // 4)::BIGINT AS tokens FROM s JOIN f ON file = path WHERE size IS NOT NULL GROUP BY file")
def saved_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that reading the symbols of a file saves against reading all of it, at four bytes a token."""
    s = symbols(spark, sf_dir, "id", "file", "byte_length").groupBy("file").agg(F.sum("byte_length").alias("read"))
    f = table(spark, sf_dir, "files").groupBy(F.col("path").alias("file")).agg(F.max("size_bytes").alias("size")).where("size is not null")
    return s.join(f, "file").where("read is not null").select("file", F.greatest(F.lit(0), F.expr("(size - read) div 4")).cast("bigint").alias("tokens"))


@REGISTRY.query(
    "code_complexity",
    "WITH t AS (SELECT DISTINCT path, content FROM file_texts WHERE content IS NOT NULL) SELECT path, CASE WHEN length(content) > 0 THEN len(regexp_extract_all(content, '"
    + M.BRANCHES.replace(r"\?(?!:)", r"\?")
    + r"')) - len(regexp_extract_all(content, '\?:')) + 1 ELSE 0 END::INTEGER AS cyclomatic FROM t",
)
def code_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 + the branches in what is kept of every file."""
    t = table(spark, sf_dir, "file_texts").where("content is not null").select("path", "content").distinct()
    return t.select("path", M.cyclomatic(F.col("content")).cast("int").alias("cyclomatic"))


@REGISTRY.query("nesting_depth")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deepest nesting of brackets in what is kept of every file."""
    t = table(spark, sf_dir, "file_texts").where("content is not null").select("path", "content").distinct()
    return t.select("path", M.bracket_depth(F.col("content")).alias("depth"))


@REGISTRY.query("param_counts", "WITH s AS (SELECT DISTINCT id, signature FROM symbols WHERE lower(kind) IN ('function', 'method')), p AS (SELECT id, trim(regexp_extract(signature, '\\(([^()]*)\\)', 1)) AS p FROM s) SELECT id, CASE WHEN p IS NULL OR p IN ('', 'void') THEN 0 ELSE len(string_split(p, ',')) END::INTEGER AS params FROM p")
def param_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of parameters by the signature."""
    s = symbols(spark, sf_dir, "id", "signature", "kind").where(F.lower("kind").isin("function", "method")).select("id", "signature").distinct()
    return s.select("id", M.param_count(F.col("signature")).alias("params"))


# ------------------------------------------------------------------ snapshots and recency


@REGISTRY.query(
    "snapshot_diff",
    """WITH a AS (SELECT path, max(hash) AS c FROM files GROUP BY path), b AS (SELECT file AS path, max(file_hash) AS c FROM branch_deltas GROUP BY file)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.c IS NOT DISTINCT FROM b.c THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the index against those of the branches."""
    a = table(spark, sf_dir, "files").groupBy("path").agg(F.max("hash").alias("c"))
    b = table(spark, sf_dir, "branch_deltas").groupBy(F.col("file").alias("path")).agg(F.max("file_hash").alias("c"))
    return S.snapshot_diff(a, b, ["path"], "c")


@REGISTRY.query(
    "file_changes",
    """WITH a AS (SELECT path, max(mtime_ns) AS m, max(hash) AS h FROM files GROUP BY path), b AS (SELECT file AS path, max(file_mtime_ns) AS m, max(file_hash) AS h FROM branch_deltas WHERE file IS NOT NULL GROUP BY file)
SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.m IS DISTINCT FROM b.m AND a.h IS DISTINCT FROM b.h THEN 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path) WHERE status IS NOT NULL""",
)
def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental run has to look at, by time and digest."""
    a = table(spark, sf_dir, "files").groupBy("path").agg(F.max("mtime_ns").alias("m"), F.max("hash").alias("h"))
    b = table(spark, sf_dir, "branch_deltas").where("file is not null").groupBy(F.col("file").alias("path")).agg(F.max("file_mtime_ns").alias("m"), F.max("file_hash").alias("h"))
    return S.file_changes(a, b, "path", "m", "h")


@REGISTRY.query(
    "branch_overlay",
    """WITH d AS (SELECT file AS path, max((lower(action), file_hash, file_language)) AS x FROM branch_deltas WHERE file IS NOT NULL AND action IS NOT NULL GROUP BY file), e AS (SELECT path, x[1] AS action, x[2] AS hash, x[3] AS language FROM d)
SELECT DISTINCT path, hash, language FROM files WHERE path NOT IN (SELECT path FROM e WHERE action IN ('delete', 'modify')) UNION ALL SELECT path, hash, language FROM e WHERE action IN ('add', 'modify')""",
)
def branch_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as they are with the branches laid over them."""
    d = table(spark, sf_dir, "branch_deltas").where("file is not null and action is not null").groupBy(F.col("file").alias("path")).agg(F.max(F.struct(F.lower("action").alias("action"), F.col("file_hash").alias("hash"), F.col("file_language").alias("language"))).alias("x"))
    base = table(spark, sf_dir, "files").select("path", "hash", "language").distinct()
    return S.overlay(base, d.select("path", "x.action", "x.hash", "x.language"), "path", "action")


@REGISTRY.query(
    "runtime_upsert",
    """WITH r AS (SELECT DISTINCT * FROM runtime_calls WHERE symbol_id <> ''), a AS (SELECT symbol_id, source, sum(count) AS c, max(p95_ms) FILTER (NOT isnan(p95_ms)) AS p, min(first_seen) AS f FROM r GROUP BY ALL),
b AS (SELECT symbol_id, 'otel' AS source, count(*) AS c, max(score) FILTER (NOT isnan(score)) AS p, '2026' AS f FROM (SELECT DISTINCT query_id, symbol_id, score FROM fused_results) GROUP BY symbol_id)
SELECT coalesce(a.symbol_id, b.symbol_id) AS symbol_id, coalesce(a.source, b.source) AS source, (coalesce(a.c, 0) + coalesce(b.c, 0))::BIGINT AS count, coalesce(b.p, a.p) AS p95, coalesce(a.f, b.f) AS first_seen FROM a FULL JOIN b ON a.symbol_id = b.symbol_id AND a.source = b.source""",
)
def runtime_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch merged into a keyed state: counts add, latencies come from the batch, first sights stay."""
    r = table(spark, sf_dir, "runtime_calls").where("symbol_id <> ''").distinct()
    state = r.groupBy("symbol_id", "source").agg(F.sum("count").alias("count"), F.max(F.when(~F.isnan("p95_ms"), F.col("p95_ms"))).alias("p95"), F.min("first_seen").alias("first_seen"))
    b = table(spark, sf_dir, "fused_results").select("query_id", "symbol_id", "score").distinct()
    batch = b.groupBy("symbol_id", F.lit("otel").alias("source")).agg(F.count("*").alias("count"), F.max(F.when(~F.isnan("score"), F.col("score"))).alias("p95"), F.lit("2026").alias("first_seen"))
    return S.keyed_upsert(state, batch, ["symbol_id", "source"], ["count"], ["p95"], ["first_seen"])


@REGISTRY.query("evicted_calls", "SELECT symbol_id, source, last_seen FROM (SELECT DISTINCT symbol_id, source, last_seen FROM runtime_calls WHERE last_seen IS NOT NULL AND symbol_id IS NOT NULL) ORDER BY last_seen DESC, symbol_id, source LIMIT 500")
def evicted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 newest rows that an eviction leaves."""
    rows = table(spark, sf_dir, "runtime_calls").where("last_seen is not null and symbol_id is not null").select("symbol_id", "source", "last_seen").distinct()
    return S.newest(rows, 500, [F.desc("last_seen"), F.asc("symbol_id"), F.asc("source")])


@REGISTRY.query(
    "session_budget",
    """WITH e AS (SELECT DISTINCT event_id, user_id, ts FROM events), g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, CASE WHEN count(*) >= 5 THEN 'over' WHEN count(*) >= 4 THEN 'near' ELSE 'within' END AS budget FROM s GROUP BY user_id, k""",
)
def session_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user by gaps of more than 30 minutes, and whether they are over a budget of events."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").distinct()
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    budget = F.when(F.col("events") >= 5, "over").when(F.col("events") >= 4, "near").otherwise("within")
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", budget.alias("budget"))


@REGISTRY.query("history_delta", "WITH d AS (SELECT strftime(make_timestamp_ns(file_mtime_ns), '%Y-%m') AS month, count(DISTINCT (branch, file)) AS n FROM branch_deltas WHERE file_mtime_ns IS NOT NULL GROUP BY 1) SELECT month, n, n - lag(n) OVER (ORDER BY month) AS delta FROM d")
def history_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each month against the one before."""
    d = table(spark, sf_dir, "branch_deltas").where("file_mtime_ns is not null")
    month = F.date_format(F.timestamp_micros(F.expr("file_mtime_ns div 1000")), "yyyy-MM")
    g = d.groupBy(month.alias("month")).agg(F.count_distinct("branch", "file").alias("n"))
    return g.select("month", "n", (F.col("n") - F.lag("n").over(Window.partitionBy(F.lit(1)).orderBy("month"))).alias("delta"))  # a row a month

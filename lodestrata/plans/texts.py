"""Queries over texts: redaction, stack frames, statements, extraction, similar records; and relational extras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.redact import PATTERNS, redact, redaction_counts
from ..operators import similar as C
from ..sources import extract as X
from ..sources import telemetry as T
from ..sources.scan import admission, language_of, skip_counts
from ..tables import table
from .code import symbols, texts
from .registry import Registry

REGISTRY = Registry()
_DOCS = "d AS (SELECT DISTINCT doc_id, source, text FROM documents WHERE text IS NOT NULL)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text").where("text is not null").distinct()


_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@REGISTRY.query(
    "redaction_counts",
    f"""WITH {_DOCS}, a AS (SELECT source, len(regexp_extract_all(text, '''(?:[^'']|'''')*''')) AS q, regexp_replace(text, '''(?:[^'']|'''')*''', '[REDACTED:sql_string_literal]', 'g') AS t FROM d),
b AS (SELECT source, q, len(regexp_extract_all(t, '{_EMAIL}')) AS e FROM a)
SELECT source, 'sql_string_literal' AS pattern, sum(q)::BIGINT AS n FROM b GROUP BY source HAVING sum(q) > 0 UNION ALL SELECT source, 'email_address', sum(e)::BIGINT FROM b GROUP BY source HAVING sum(e) > 0""",
)
def redaction_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two patterns fire per kind of text."""
    return redaction_counts(docs(spark, sf_dir), "text", ["source"], [p for p in PATTERNS if p[0] in ("sql_string_literal", "email_address")])


@REGISTRY.query("redacted_texts")
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with every pattern redacted, as digests."""
    return docs(spark, sf_dir).select("doc_id", F.md5(redact(F.col("text"))).alias("digest"))


@REGISTRY.query(
    "stack_frames",
    f"""WITH {_DOCS}, h AS (SELECT doc_id, 'python' AS runtime, unnest(regexp_extract_all(text, 'File "([^"\\n]+)", line (\\d+), in ([\\w<>.]+)')) AS f FROM d
 UNION ALL SELECT doc_id, 'jvm', unnest(regexp_extract_all(text, '(?m)^\\s*at ([\\w.$<>]+)\\(([\\w$]+\\.\\w+):(\\d+)\\)')) FROM d
 UNION ALL SELECT doc_id, 'node', unnest(regexp_extract_all(text, '(?m)^\\s*at (?:async )?([\\w.$<>\\[\\] ]+?) \\(([^()\\n:]+):(\\d+)(?::\\d+)?\\)')) FROM d)
SELECT doc_id, runtime, count(*) AS frames FROM h GROUP BY ALL""",
)
def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack frames of three runtimes in the texts."""
    return T.stack_frames(docs(spark, sf_dir), "doc_id", "text").groupBy("doc_id", "runtime").agg(F.count("*").alias("frames"))


@REGISTRY.query("log_severity", f"WITH {_DOCS} SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(?:fatal|critical|panic)\\b') THEN 'fatal' WHEN regexp_matches(lower(text), '\\berror\\b|exception\\b|traceback') THEN 'error' WHEN regexp_matches(lower(text), '\\bwarn(?:ing)?\\b') THEN 'warning' ELSE 'info' END AS severity FROM d WHERE source = 'stack_log'")
def log_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest level that each stack log names."""
    return docs(spark, sf_dir).where("source = 'stack_log'").select("doc_id", T.severity(F.col("text")).alias("severity"))


@REGISTRY.query("sql_tables", f"WITH {_DOCS}, n AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:from|join|into|update|table)\\s+\"?((?:\\w+\"?\\.\"?)*\\w+)', 1)) AS n FROM d WHERE source = 'code') SELECT doc_id, lower(regexp_extract(replace(n, '\"', ''), '[^.]*$')) AS name, count(*) > 0 AS named FROM n GROUP BY ALL")
def sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that code names in statements."""
    rows = docs(spark, sf_dir).where("source = 'code'")
    return rows.select("doc_id", F.explode(T.sql_tables(F.col("text"))).alias("name")).select("doc_id", "name", F.lit(True).alias("named"))


@REGISTRY.query("python_nodes")
def python_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, classes, calls, loops and strings of the Python files, counted per file and kind."""
    rows = texts(spark, sf_dir).where(F.col("path").endswith(".py"))
    return X.python_nodes(rows).groupBy("path", "kind").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@REGISTRY.query("node_search")
def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of ten lines or more in Python files, with the symbol around them."""
    nodes = X.python_nodes(texts(spark, sf_dir).where(F.col("path").endswith(".py"))).where(X.node_filter("lines:>=10"))
    return X.enclosing(nodes, symbols(spark, sf_dir, "id", "file", "line", "end_line")).select("path", "name", "line", "symbol")


@REGISTRY.query("go_declarations", "WITH t AS (SELECT DISTINCT path, content FROM file_texts WHERE path LIKE '%.go' AND content IS NOT NULL), l AS (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM t) SELECT path, 'function' AS kind, regexp_extract(x, '^func\\s+(?:\\([^)]*\\)\\s*)?(\\w+)', 1) AS name, line::INTEGER AS line FROM l WHERE regexp_matches(x, '^func\\s+(?:\\([^)]*\\)\\s*)?(\\w+)') UNION ALL SELECT path, 'type', regexp_extract(x, '^type\\s+(\\w+)', 1), line::INTEGER FROM l WHERE regexp_matches(x, '^type\\s+(\\w+)')")
def go_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and types of the Go files, found line by line."""
    return X.declared(texts(spark, sf_dir).where(F.col("path").endswith(".go")), "go")


@REGISTRY.query(
    "file_admission",
    """WITH f AS (SELECT path, max(size_bytes) AS s FROM files GROUP BY path), r AS (SELECT CASE WHEN regexp_matches(path, '(?:^|/)(?:node_modules|\\.git|__pycache__|venv|\\.venv|dist|build|\\.tox|\\.mypy_cache|target|vendor)/') THEN 'skipped_dir'
 WHEN regexp_matches(path, '^(?:.*/)?[^/]*_token[^/]*(?:/.*)?$') THEN 'ignored' WHEN NOT regexp_matches(path, '[.](py|jsx?|tsx?|go|java)$') THEN 'unknown_language' WHEN s IS NULL OR s > 512000 THEN 'too_large' ELSE 'read' END AS reason FROM f)
SELECT reason, count(*) AS files FROM r GROUP BY reason""",
)
def file_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files an index run would read, and why it turns others away."""
    f = table(spark, sf_dir, "files").groupBy("path").agg(F.max("size_bytes").alias("size"))
    return skip_counts(f.withColumn("reason", admission(F.col("path"), F.col("size"), ["*_token*"])), "reason")


@REGISTRY.query("path_languages", "SELECT CASE regexp_extract(path, '[.]([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' END AS language, count(DISTINCT path) AS files FROM files GROUP BY 1")
def path_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the language of their ending."""
    return table(spark, sf_dir, "files").groupBy(language_of(F.col("path")).alias("language")).agg(F.count_distinct("path").alias("files"))


_SIM = """WITH s AS (SELECT DISTINCT id, keywords, summary, byte_length FROM symbols WHERE lower(kind) IN ('function', 'method')),
w AS (SELECT id, list_distinct(list_concat(coalesce(keywords, []), regexp_extract_all(lower(coalesce(summary, '')), '[a-z]{4,}'))) AS t, byte_length AS s FROM s),
f AS (SELECT a.id AS src, c.id AS dst, round(0.7e0 * len(list_intersect(a.t, c.t)) / len(list_distinct(list_concat(a.t, c.t))) + 0.3e0 * CASE WHEN a.s > 0 AND c.s > 0 THEN least(a.s, c.s) / greatest(a.s, c.s) ELSE 0 END, 6) AS similarity
  FROM w a JOIN w c ON a.id < c.id AND len(a.t) > 0 AND len(c.t) > 0 AND least(len(a.t), len(c.t)) >= 0.571e0 * greatest(len(a.t), len(c.t)) AND list_has_any(a.t, c.t)),
n AS (SELECT src AS id, dst AS other, similarity FROM f WHERE similarity >= 0.7 UNION ALL SELECT dst, src, similarity FROM f WHERE similarity >= 0.7)
SELECT id, count(*) AS links, arg_min(other, (-similarity, other)) AS nearest, max(similarity) AS similarity FROM n GROUP BY id"""


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, byte_length: the functions with the words that they are compared by."""
    s = symbols(spark, sf_dir, "id", "kind", "keywords", "summary", "byte_length").where(F.lower("kind").isin("function", "method")).drop("kind").distinct()
    t = F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.regexp_extract_all(F.lower(F.coalesce("summary", F.lit(""))), F.lit("[a-z]{4,}"), 0))
    return s.select("id", t.alias("t"), "byte_length")


@REGISTRY.query("similar_symbols", _SIM)
def similar_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function that others are like in words and size, with their number and the nearest of them."""
    return C.similar_nearest(_worded(spark, sf_dir), "id", "t", "byte_length", 0.7)


@REGISTRY.query("similar_clusters")
def similar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their clusters, with each function's number of pairs."""
    return C.similar_clusters(_worded(spark, sf_dir), "id", "t", "byte_length", 0.7)


@REGISTRY.query("order_cube", "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by segment, priority, both and neither."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey").cube("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@REGISTRY.query("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and averages over the line items by two flags."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= date '1998-09-02'")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@REGISTRY.query("running_value", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS last5, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events")
def running_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of a user's last five values and the kind of the next event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-4, 0)), 4).alias("last5"), F.lead("event_type").over(w).alias("next_type"))


@REGISTRY.query("part_sets", "(SELECT p_partkey AS k, 'unsold' AS what FROM part EXCEPT SELECT l_partkey, 'unsold' FROM lineitem) UNION ALL (SELECT p_partkey, 'returned' FROM part INTERSECT SELECT l_partkey, 'returned' FROM lineitem WHERE l_returnflag = 'R')")
def part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts never sold and parts that came back, by set operations."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    back = p.intersect(sold.where("l_returnflag = 'R'").select("k"))
    return p.subtract(sold.select("k")).withColumn("what", F.lit("unsold")).unionByName(back.withColumn("what", F.lit("returned")))


@REGISTRY.query("event_windows", "SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind a day."""
    from ..streaming.ingest import windowed_counts

    rows = windowed_counts(table(spark, sf_dir, "events"), ["event_type"], "ts", "1 day", None, "1 hour")
    return rows.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")

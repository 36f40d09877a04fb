"""Sources of traces, SQL logs and stack logs, and what is taken from their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:struct<values:array<struct<stringValue:string,intValue:string>>>>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
TRACE = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<struct<name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES}>>>>>>"


def read_traces(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Traces in JSON lines, or whole JSON files; gzip by its ending. Lines that are no JSON are dropped."""
    return spark.read.schema(TRACE).option("mode", "DROPMALFORMED").option("multiLine", str(not lines).lower()).json(path)


def attribute_text(value: Column) -> Column:
    """The value of an attribute as text; lists are joined by commas."""
    listed = F.array_join(F.transform(value["arrayValue"]["values"], lambda v: F.coalesce(v["stringValue"], v["intValue"])), ",")
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string"), value["boolValue"].cast("string"), listed)


def spans(traces: DataFrame) -> DataFrame:
    """name, file_path, line_no, function_name, duration_ms of every span; what is missing or wrong is null.

    Of an attribute that stands twice the last value holds.
    """
    s = traces.select(F.explode("resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x")).select("x.*")
    get = lambda key: attribute_text(F.element_at(F.filter("attributes", lambda a: a["key"] == key), -1)["value"])
    has = lambda key: F.when(F.exists("attributes", lambda a: a["key"] == key), get(key))
    start, end = F.col("startTimeUnixNano").try_cast("bigint"), F.col("endTimeUnixNano").try_cast("bigint")
    return s.select(
        "name",
        F.coalesce(has("code.filepath"), has("code.file.path")).alias("file_path"),
        F.coalesce(has("code.lineno"), has("code.line.number")).try_cast("int").alias("line_no"),
        F.coalesce(has("code.function"), has("code.function.name")).alias("function_name"),
        F.when(end >= start, (end - start) / 1e6).alias("duration_ms"),
    )


def read_sql_stats(spark: SparkSession, path: str) -> DataFrame:
    """query, calls, total_ms, mean_ms of statement statistics in CSV, whatever the case and version of the header."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    low = raw.toDF(*(c.strip().lower() for c in raw.columns))
    first = lambda *names: F.coalesce(*(F.col(n).try_cast("double") for n in names if n in low.columns), F.lit(None).cast("double"))
    calls = F.coalesce(first("calls").cast("bigint"), F.lit(1))
    return low.where("query <> ''").select("query", calls.alias("calls"), first("total_exec_time", "total_time").alias("total_ms"), first("mean_exec_time", "mean_time").alias("mean_ms"))


def read_sql_lines(spark: SparkSession, path: str) -> DataFrame:
    """query, calls, duration_ms, ts of JSON lines; blank lines, comments and what is no JSON are passed over."""
    text = spark.read.text(path).where(r"value rlike '^\\s*\\{'")
    row = F.from_json("value", "sql string, query string, duration_ms string, ts string, calls string")
    parsed = text.select(row.alias("r")).select("r.*").withColumn("q", F.coalesce("sql", "query")).where("q <> ''")
    calls = F.coalesce(F.col("calls").try_cast("double").cast("bigint"), F.lit(1))
    return parsed.select(F.col("q").alias("query"), calls.alias("calls"), F.col("duration_ms").try_cast("double").alias("duration_ms"), "ts")


def sql_tables(sql: Column) -> Column:
    """The tables that a statement names, without schema, in the order in which they come first."""
    names = F.regexp_extract_all(sql, F.lit(r'(?i)\b(?:from|join|into|update|table)\s+"?((?:\w+"?\."?)*\w+)'), 1)
    return F.array_distinct(F.transform(names, lambda n: F.lower(F.element_at(F.split(F.regexp_replace(n, '"', ""), r"\."), -1))))


# Words of the language that are no columns.
_SQL_WORDS = "select from where and or not in is null as on join left right inner outer group by order having limit distinct case when then else end like between asc desc count sum min max avg union all values set insert update delete into".split()


def sql_columns(sql: Column) -> Column:
    """The columns that a statement names: qualified ones anywhere, bare ones in the select list and conditions."""
    qualified = F.regexp_extract_all(sql, F.lit(r"\b\w+\.(\w+)\b"), 1)
    listed = F.split(F.regexp_extract(sql, r"(?is)\bselect\s+(.*?)\s+from\b", 1), r"\W+")
    tested = F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:where|and|or|on|having|by)\s+(\w+)\b(?!\s*\.|\s*\()"), 1)
    words = F.transform(F.concat(qualified, listed, tested), lambda w: F.lower(w))
    real = F.filter(F.array_distinct(words), lambda w: w.rlike("^[a-z_][a-z0-9_]*$"))
    return F.array_except(real, F.concat(F.array(*map(F.lit, _SQL_WORDS)), sql_tables(sql)))


def strip_templates(sql: Column) -> Column:
    """A statement without template syntax: references become table names, blocks and comments go."""
    sql = F.regexp_replace(sql, r"\{#[\s\S]*?#\}", "")
    sql = F.regexp_replace(sql, r"\{\{\s*ref\(\s*['\"](\w+)['\"]\s*\)\s*\}\}", "$1")
    sql = F.regexp_replace(sql, r"\{\{\s*source\(\s*['\"]\w+['\"]\s*,\s*['\"](\w+)['\"]\s*\)\s*\}\}", "$1")
    sql = F.regexp_replace(sql, r"\{\{[\s\S]*?\}\}", "NULL")
    return F.regexp_replace(sql, r"\{%[\s\S]*?%\}", "")


#: runtime, pattern with file, line and function by group
FRAMES = (
    ("python", r'File "([^"\n]+)", line (\d+), in ([\w<>.]+)', (1, 2, 3)),
    ("jvm", r"(?m)^\s*at ([\w.$<>]+)\(([\w$]+\.\w+):(\d+)\)", (2, 3, 1)),
    ("node", r"(?m)^\s*at (?:async )?([\w.$<>\[\] ]+?) \(([^()\n:]+):(\d+)(?::\d+)?\)", (2, 3, 1)),
)


def stack_frames(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, runtime, place, file, line, function of every stack frame in texts, place counting from 1 per runtime.

    The patterns find all frames of a text in the JVM; each match then gives its parts.
    """
    parts = []
    for runtime, pattern, (f, n, fn) in FRAMES:
        hits = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("at", "frame"))
        one = lambda i, p=pattern: F.regexp_extract("frame", p, i)
        parts.append(hits.select(key, F.lit(runtime).alias("runtime"), (F.col("at") + 1).alias("place"), one(f).alias("file"), one(n).cast("int").alias("line"), F.trim(one(fn)).alias("function")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def severity(text: Column) -> Column:
    """The gravest level that a log text names; info where it names none."""
    low = F.lower(text)
    out = None
    for level, pattern in (("fatal", r"\b(?:fatal|critical|panic)\b"), ("error", r"\berror\b|exception\b|traceback"), ("warning", r"\bwarn(?:ing)?\b")):
        out = F.when(low.rlike(pattern), level) if out is None else out.when(low.rlike(pattern), level)
    return out.otherwise("info")

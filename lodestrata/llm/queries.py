"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..tables import table
from .codefiles import classify_files
from .distinctive import term_scores, top_term, words
from .docpairs import pair_source, pair_symbols
from .encode import encode_corpus, token_counts
from .fusion import best_per_query, ranks, reciprocal_rank_fusion
from .lookalike import canonical_texts, same_looking_pairs
from .mixture import mix, mix_report
from .quantiles import measured, multi_select

REGISTRY = Registry()


@REGISTRY.query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were not written by hand for their repository."""
    return p1_marks(spark, sf_dir).select("path")


@REGISTRY.query("p1_marks")
def p1_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with what they are and how that came out."""
    return classify_files(table(spark, sf_dir, "files").select("path"), table(spark, sf_dir, "file_texts").select("path", "content"))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols")


@REGISTRY.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods whose docstring says something about them."""
    return pair_symbols(_symbols(spark, sf_dir)).select("symbol_id")


@REGISTRY.query("p2_pairs")
def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with signature and docstring."""
    return pair_symbols(_symbols(spark, sf_dir))


@REGISTRY.query("p2_source_pairs")
def p2_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature, docstring and body of the documented functions in the file texts themselves."""
    texts = table(spark, sf_dir, "file_texts").select("path", "content")
    language = F.when(F.col("path").endswith(".py"), "python").otherwise("other").alias("language")
    return pair_source(texts.select("path", "content", language))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "tool_calls").select("call_id", "ts", "tool", "duration_ms").where(measured(F.col("duration_ms"))).distinct()
    day = F.date_format(F.to_utc_timestamp(F.timestamp_seconds("ts"), F.current_timezone()), "yyyy-MM-dd")
    tools = calls.select(F.lit("tool_calls").alias("table_name"), F.col("tool").alias("grp"), F.col("duration_ms").alias("v"), F.coalesce(day, F.lit("unknown")).alias("day"))
    runs = table(spark, sf_dir, "runtime_calls").where(measured(F.col("p95_ms"))).distinct()
    seen = runs.select(F.lit("runtime_calls").alias("table_name"), F.col("source").alias("grp"), F.col("p95_ms").alias("v"), F.coalesce(F.substring("last_seen", 1, 10), F.lit("unknown")).alias("day"))
    return tools.unionByName(seen)


_PERCENTILES = """
WITH r AS (
  SELECT 'tool_calls' AS table_name, tool AS grp, duration_ms AS v
  FROM (SELECT DISTINCT call_id, ts, tool, duration_ms FROM tool_calls) WHERE duration_ms >= 0 AND NOT isnan(duration_ms) AND tool IS NOT NULL
  UNION ALL
  SELECT 'runtime_calls', source, p95_ms FROM (SELECT DISTINCT * FROM runtime_calls) WHERE p95_ms >= 0 AND NOT isnan(p95_ms) AND source IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY table_name, grp ORDER BY v) AS k, count(*) OVER (PARTITION BY table_name, grp) AS n FROM r)
SELECT table_name, grp, n, percent, v AS value
FROM o, (VALUES (0.5e0), (0.9e0), (0.95e0), (0.99e0)) p(percent) WHERE k = ceil(percent * n)
"""


@REGISTRY.query("p4_percentiles", _PERCENTILES)
def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile per tool and per source, over all rows."""
    return multi_select(_durations(spark, sf_dir), ["table_name", "grp"], "v")


@REGISTRY.query("p4_from_days", _PERCENTILES)
def p4_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same put together from what single days count."""
    return multi_select(_durations(spark, sf_dir), ["table_name", "grp"], "v", F.col("day"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fused_results").select("query_id", "symbol_id", "raw_scores")
    return reciprocal_rank_fusion(rows, "query_id", "symbol_id", "raw_scores")


_RRF = """
WITH c AS (
  SELECT query_id, symbol_id, e.key AS channel, max(e.value) AS score
  FROM (SELECT query_id, symbol_id, unnest(map_entries(raw_scores)) AS e FROM fused_results)
  WHERE e.value IS NOT NULL AND NOT isnan(e.value) AND query_id IS NOT NULL AND symbol_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, channel ORDER BY score DESC) AS rk FROM c),
f AS (SELECT query_id, symbol_id, round(sum(1e0 / (60 + rk)), 12) AS fused, count(*) AS channels FROM r GROUP BY ALL),
a AS (
  SELECT query_id, symbol_id, coalesce(fused, 0e0) AS fused, coalesce(channels, 0) AS channels
  FROM (SELECT DISTINCT query_id, symbol_id FROM fused_results WHERE query_id IS NOT NULL AND symbol_id IS NOT NULL) LEFT JOIN f USING (query_id, symbol_id))
"""


@REGISTRY.query("p5_found", _RRF + "SELECT query_id, arg_min(symbol_id, (-fused, symbol_id)) AS symbol_id FROM a GROUP BY query_id")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of each query when every channel has the same say."""
    return best_per_query(_fused(spark, sf_dir), "query_id", "symbol_id")


@REGISTRY.query("p5_ranking", _RRF + "SELECT *, rank() OVER (PARTITION BY query_id ORDER BY fused DESC) AS rank FROM a")
def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of each query in one order; equal scores share a rank."""
    return ranks(_fused(spark, sf_dir), ["query_id"], "fused")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _symbols(spark, sf_dir).select("id", "name", "keywords", "summary").distinct()
    return rows.select("id", words(F.col("name"), F.array_join("keywords", " "), F.col("summary")).alias("terms"))


_KL = """
WITH s AS (
  SELECT DISTINCT id, name, keywords, summary FROM symbols WHERE id IS NOT NULL),
w AS (
  SELECT id, regexp_extract_all(concat_ws(' ', regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), array_to_string(keywords, ' '), summary), '[A-Za-z]+') AS terms FROM s),
e AS (SELECT id, len(terms) AS dl, lower(unnest(terms)) AS term FROM w),
t AS (SELECT id, dl, term, count(*) AS tf FROM e GROUP BY ALL),
c AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM t GROUP BY term),
z AS (SELECT sum(cf)::DOUBLE AS size, sum(cf)::DOUBLE / (SELECT count(*) FROM w WHERE len(terms) > 0) AS mu FROM c),
p AS (SELECT id, term, tf, df::BIGINT AS df, cf / size AS q, (tf + mu * (cf / size)) / (dl + mu) AS p FROM t JOIN c USING (term), z WHERE df >= 2)
"""


@REGISTRY.query("p7_found", _KL + "SELECT id AS symbol_id, arg_min(term, (-round(p * ln(p / q), 12), term)) AS term FROM p WHERE id IN (SELECT symbol_id FROM probe_symbols) GROUP BY id")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most characteristic word of each symbol asked about, against all symbols."""
    probes = table(spark, sf_dir, "probe_symbols").select(F.col("symbol_id").alias("id"))
    return top_term(term_scores(_terms(spark, sf_dir), probes)).select(F.col("id").alias("symbol_id"), "term")


@REGISTRY.query("p7_terms", _KL + "SELECT id AS symbol_id, term, tf, df, round(round(p * ln(p / q), 12), 6) AS score FROM p")
def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all symbols with their scores."""
    return term_scores(_terms(spark, sf_dir)).select(F.col("id").alias("symbol_id"), "term", "tf", "df", F.round("score", 6).alias("score"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").distinct()


@REGISTRY.query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(_documents(spark, sf_dir))


@REGISTRY.query("p8_counts")
def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    return token_counts(_documents(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").distinct()
    return token_counts(docs, keep=["source"])


@REGISTRY.query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, each copy with the slot of the schedule that it falls into."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")).select("doc_id", "source", "copy", "slot", "n_tokens")


@REGISTRY.query("p9_report")
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share and repeats of every source of the mix."""
    targets = table(spark, sf_dir, "mix_targets")
    sized = _sized(spark, sf_dir)
    return mix_report(mix(sized, targets), targets)


@REGISTRY.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same but differ in their characters."""
    return same_looking_pairs(canonical_texts(_documents(spark, sf_dir)))


@REGISTRY.query("p10_canonical")
def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one consistent form of every text."""
    return canonical_texts(_documents(spark, sf_dir)).select("doc_id", "canonical")

"""Queries of ranked retrieval over symbols, vectors and ranking events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import identity_score
from ..functions.text import ABBREVIATIONS, json_list, raw_tokens, stem_sql
from ..operators import ranking as R
from ..session import Cuts
from ..tables import table
from .graphs import _CALLS, _IMPORTED, _RANKED, file_ranks, import_edges, symbol_uses
from .registry import Registry

REGISTRY = Registry()
TERMS = ("parse", "config", "schema")
FIELDS = ("name", "keywords", "signature", "summary", "docstring")
# Words by which a task is told.
INTENTS = {
    "debug": ("error", "fix", "bug", "fail", "why"),
    "explore": ("where", "how", "list", "show", "find"),
    "refactor": ("rename", "move", "extract", "split", "merge"),
    "extend": ("add", "create", "build", "new", "support"),
}


def symbols(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Columns of the symbols, repeated rows once."""
    return table(spark, sf_dir, "symbols").select(*cols).distinct()


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir, "id", "file", *FIELDS)


def _aside(sql: str) -> str:
    """CTEs over the symbols as further ones, beside others that call theirs s as well."""
    return re.sub(r"\bFROM s\b", "FROM s1", sql.replace("WITH RECURSIVE s AS", ", s1 AS"))


_BAG = f"""
WITH RECURSIVE s AS (SELECT DISTINCT id, file, name, keywords, signature, summary, docstring FROM symbols),
abbr(word, form) AS (VALUES {", ".join(f"('{w}', '{o}')" for w, others in ABBREVIATIONS.items() for o in others.split())}),
txt AS (
  SELECT id, 'name' AS field, 3 AS w, name AS t FROM s UNION ALL SELECT id, 'signature', 2, signature FROM s
  UNION ALL SELECT id, 'summary', 1, summary FROM s UNION ALL SELECT id, 'docstring', 1, docstring FROM s),
lst AS (SELECT id, field, w, regexp_extract_all(regexp_replace(coalesce(t, ''), '([a-z])([A-Z])', '\\1_\\2', 'g'), '[a-zA-Z0-9]{{2,}}') AS l FROM txt),
raw AS (SELECT id, field, w, generate_subscripts(l, 1) AS i, lower(unnest(l)) AS tok FROM lst),
st AS (SELECT *, {stem_sql("tok")} AS stem FROM raw),
gen AS (
  SELECT id, field, w, i, stem AS e FROM st
  UNION ALL SELECT id, field, w, i, form FROM st JOIN abbr ON word = tok
  UNION ALL SELECT id, field, w, i, form FROM st JOIN abbr ON word = stem),
g1 AS (SELECT id, field, w, e, min(i) AS i FROM gen GROUP BY ALL),
r1 AS (SELECT id, field, tok, min(i) AS i FROM raw GROUP BY ALL),
extra AS (SELECT g1.id, g1.field, g1.w, g1.e AS tok FROM g1 LEFT JOIN r1 ON g1.id = r1.id AND g1.field = r1.field AND g1.e = r1.tok WHERE r1.i IS NULL OR r1.i > g1.i),
bag AS (
  SELECT id, field, w, tok FROM raw UNION ALL SELECT id, field, w, tok FROM extra
  UNION ALL SELECT id, 'keywords', 2, lower(unnest(keywords)) FROM s),
dl AS (SELECT s.id, count(DISTINCT tok) AS dl FROM s LEFT JOIN bag USING (id) GROUP BY s.id),
z AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q(term) AS (VALUES ('parse'), ('config'), ('schema')),
df AS (SELECT term, count(DISTINCT id) AS df FROM bag JOIN q ON term = tok GROUP BY term),
tf AS (SELECT id, term, sum(w) AS tf FROM bag JOIN q ON term = tok GROUP BY ALL),
lex AS (
  SELECT id, sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))) AS lexical
  FROM tf JOIN df USING (term) JOIN dl USING (id), z GROUP BY id),
ident AS (
  SELECT id, CASE WHEN lower(name) IN ('parse config schema', 'parse_config_schema') OR lower(id) IN ('parse config schema', 'parse_config_schema') THEN 50e0
    WHEN lower(name) LIKE 'parse config schema%' OR starts_with(lower(name), 'parse_config_schema') THEN 30e0
    WHEN contains(lower(id), 'parse config schema') OR contains(lower(id), 'parse_config_schema') THEN 20e0 ELSE 0e0 END AS identity FROM s)
"""


@REGISTRY.query("bm25_topk", _BAG + "SELECT id, round(lexical, 6) AS score FROM lex ORDER BY score DESC, id LIMIT 100")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 100 symbols for a query by BM25 over weighted fields."""
    scored = R.bm25(_ranked(spark, sf_dir), TERMS).select("id", F.round("lexical", 6).alias("score"))
    return R.top_k(scored, 100, [F.desc("score"), F.asc("id")])


@REGISTRY.query("bm25_stats", _BAG + "SELECT term, df, round(ln((n - df + 0.5e0) / (df + 0.5e0) + 1), 9) AS idf, n, round(avgdl, 9) AS avgdl FROM df, z")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of the query terms, number and average length of the symbols."""
    rows = R.profiled(_ranked(spark, sf_dir), TERMS)
    counts = [F.col("df_")[i].alias(t) for i, t in enumerate(TERMS)]
    stats = R.collection_stats(rows, len(TERMS)).select(F.col("n_").alias("n"), F.round("avgdl_", 9).alias("avgdl"), *counts)
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(t).alias("df")) for t in TERMS))).alias("p")
    return stats.select(pairs, "n", "avgdl").select("p.term", "p.df", F.round(F.log((F.col("n") - F.col("p.df") + 0.5) / (F.col("p.df") + 0.5) + 1), 9).alias("idf"), "n", "avgdl")


@REGISTRY.query(
    "bm25_fields",
    _BAG
    + """, ftf AS (SELECT id, field, term, sum(w) AS tf FROM bag JOIN q ON term = tok GROUP BY ALL),
fs AS (
  SELECT id, field, sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))) AS s
  FROM ftf JOIN df USING (term) JOIN dl USING (id), z GROUP BY ALL)
SELECT id, """
    + ", ".join(f"round(coalesce(max(s) FILTER (field = '{f}'), 0e0), 3) AS s_{f}" for f in FIELDS)
    + " FROM fs GROUP BY id",
)
def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each field adds to the score of every symbol that is hit."""
    return R.bm25(_ranked(spark, sf_dir), TERMS, split=True).select("id", *(F.round(f"s_{f}", 3).alias(f"s_{f}") for f in FIELDS))


_CENTRAL = _aside(_CALLS) + ", central AS (SELECT file, sum(callers) AS n FROM uses GROUP BY file HAVING sum(callers) > 0)\n"


def _centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, n: how often symbols of other files call a symbol of the file."""
    return symbol_uses(spark, sf_dir).groupBy("file").agg(F.sum("callers").alias("n")).where("n > 0")


@REGISTRY.query(
    "symbol_search",
    _BAG
    + _CENTRAL
    + """SELECT id, round(lexical + identity + CASE WHEN lexical + identity > 0 THEN 0.3e0 * ln(1 + coalesce(n, 0)) ELSE 0 END, 6) AS score
FROM lex JOIN ident USING (id) JOIN s USING (id) LEFT JOIN central USING (file) ORDER BY score DESC, id LIMIT 100""",
)
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25, identity and centrality together."""
    return R.search(_ranked(spark, sf_dir), TERMS, "id", 100, _centrality(spark, sf_dir), "file").select("id", "score")


@REGISTRY.query("identity_rank", "WITH s AS (SELECT DISTINCT id, name FROM symbols) SELECT id, CASE WHEN lower(name) = 'parse_config' OR lower(id) = 'parse_config' THEN 50e0 WHEN starts_with(lower(name), 'parse_config') THEN 30e0 WHEN contains(lower(id), 'parse_config') THEN 20e0 ELSE 0e0 END AS score FROM s WHERE contains(lower(id), 'parse_config') OR starts_with(lower(name), 'parse_config')")
def identity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity scores of the symbols that match a name at all."""
    rows = symbols(spark, sf_dir, "id", "name")
    return rows.select("id", identity_score(F.col("name"), F.col("id"), "parse_config", "parse_config").alias("score")).where("score > 0")


@REGISTRY.query(
    "legacy_score",
    """WITH s AS (SELECT DISTINCT id, lower(coalesce(name, '')) AS name, lower(coalesce(signature, '')) AS sig, lower(coalesce(summary, '')) AS sm, lower(coalesce(docstring, '')) AS doc, coalesce(keywords, []) AS kw FROM symbols),
p AS (SELECT id, (CASE WHEN name = 'parse config' THEN 20 WHEN contains(name, 'parse config') THEN 10 ELSE 0 END)
 + 5 * (contains(name, 'parse')::INT + contains(name, 'config')::INT) + (CASE WHEN contains(sig, 'parse config') THEN 8 ELSE 0 END) + 2 * (contains(sig, 'parse')::INT + contains(sig, 'config')::INT)
 + (CASE WHEN contains(sm, 'parse config') THEN 5 ELSE 0 END) + (contains(sm, 'parse')::INT + contains(sm, 'config')::INT)
 + 3 * (list_contains(kw, 'parse')::INT + list_contains(kw, 'config')::INT) + (contains(doc, 'parse')::INT + contains(doc, 'config')::INT) AS score FROM s)
SELECT id, score FROM p WHERE score > 0""",
)
def legacy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older additive score over whole words of a query."""
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "signature", "summary", "docstring")}
    has = lambda c, q: F.contains(low[c], F.lit(q)).cast("int")
    words, query = ("parse", "config"), "parse config"
    score = F.when(low["name"] == query, 20).when(F.contains(low["name"], F.lit(query)), 10).otherwise(0) + 8 * has("signature", query) + 5 * has("summary", query)
    for w in words:
        kw = F.coalesce(F.array_contains("keywords", w), F.lit(False)).cast("int")
        score = score + 5 * has("name", w) + 2 * has("signature", w) + has("summary", w) + 3 * kw + has("docstring", w)
    return symbols(spark, sf_dir, "id", "name", "signature", "summary", "docstring", "keywords").select("id", score.alias("score")).distinct().where("score > 0")


@REGISTRY.query(
    "fuzzy_names",
    """WITH n AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL),
g AS (SELECT name, CASE WHEN length(name) < 3 THEN [lower(name)] ELSE list_distinct([substring(lower(name), i::INT, 3) for i in range(1, length(name) - 1)]) END AS a, list_distinct([substring('parseconfigs', i::INT, 3) for i in range(1, 11)]) AS b FROM n),
x AS (SELECT name, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity, levenshtein(lower(name), 'parseconfigs')::INTEGER AS edits FROM g)
SELECT * FROM x WHERE similarity >= 0.4 OR edits <= 2""",
)
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names near a misspelt one, by trigrams or by edits."""
    names = table(spark, sf_dir, "symbols").select("name").where("name is not null").distinct()
    return R.fuzzy(names, "name", "parseConfigs")


_VEC = """WITH e AS (SELECT DISTINCT symbol_id, embedding FROM symbol_embeddings WHERE symbol_id <> '' AND len(embedding) = 16),
v AS (SELECT symbol_id, min(embedding::DOUBLE[]) AS v FROM e GROUP BY symbol_id),
qv AS (SELECT arg_min(v, symbol_id) AS q FROM v),
c AS (SELECT symbol_id, CASE WHEN list_dot_product(v, v) = 0 THEN 0e0 ELSE list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) END AS sim FROM v, qv)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "symbol_embeddings").where("symbol_id <> '' and size(embedding) = 16")
    v = rows.groupBy("symbol_id").agg(F.min(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return v, v.agg(F.min_by("v", "symbol_id").alias("q"))


@REGISTRY.query("cosine_topk", _VEC + "SELECT symbol_id, round(sim, 5) AS similarity FROM c ORDER BY similarity DESC, symbol_id LIMIT 50")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 vectors nearest to one of them by cosine."""
    v, q = _vectors(spark, sf_dir)
    return R.top_k(R.with_cosine(v, "v", q).select("symbol_id", F.round("similarity", 5).alias("similarity")), 50, [F.desc("similarity"), F.asc("symbol_id")])


@REGISTRY.query(
    "hybrid_search",
    _BAG.replace("WITH RECURSIVE s", _VEC.replace("WITH e", "WITH RECURSIVE e") + ", s", 1)
    + "SELECT lex.id, round(0.5e0 * lexical / (SELECT max(lexical) FROM lex) + 0.5e0 * coalesce(sim, 0), 5) AS score FROM lex LEFT JOIN c ON lex.id = symbol_id WHERE 0.5e0 * lexical / (SELECT max(lexical) FROM lex) + 0.5e0 * coalesce(sim, 0) > 0",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half BM25 by its maximum, half cosine, over the symbols that hold a query term."""
    v, q = _vectors(spark, sf_dir)
    near = R.with_cosine(v, "v", q).select(F.col("symbol_id").alias("id"), "similarity")
    joined = R.bm25(_ranked(spark, sf_dir), TERMS).join(near, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return R.hybrid(joined, "lexical", "similarity").select("id", F.round("hybrid", 5).alias("score"))


@REGISTRY.query(
    "fusion_search",
    _BAG.replace("WITH RECURSIVE s", _VEC.replace("WITH e", "WITH RECURSIVE e") + ", s", 1)
    + _aside(_RANKED)
    + """, ch AS (
  SELECT id, 1e0 AS w, row_number() OVER (ORDER BY round(lexical, 9) DESC, id) AS rk FROM lex
  UNION ALL SELECT id, 2e0, row_number() OVER (ORDER BY identity DESC, id) FROM ident WHERE identity > 0
  UNION ALL SELECT lex.id, 0.4e0, row_number() OVER (ORDER BY rank DESC, lex.id) FROM lex JOIN s USING (id) JOIN fr USING (file) WHERE rank > 0
  UNION ALL SELECT symbol_id, 0.8e0, row_number() OVER (ORDER BY round(sim, 9) DESC, symbol_id) FROM c WHERE sim >= 0.1)
SELECT id, round(sum(w / (60 + rk)), 9) AS score FROM ch GROUP BY id""",
)
def fusion_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical, identity, structural (PageRank of the file) and similarity channels fused by weighted reciprocal ranks."""
    rows = _ranked(spark, sf_dir)
    lexical = Cuts(spark).cut(R.bm25(rows, TERMS).select("id", "file", F.round("lexical", 9).alias("lexical")))
    identity = rows.select("id", identity_score(F.col("name"), F.col("id"), " ".join(TERMS), "_".join(TERMS)).alias("identity"))
    structural = lexical.join(file_ranks(spark, sf_dir), "file")
    v, q = _vectors(spark, sf_dir)
    near = R.with_cosine(v, "v", q).select(F.col("symbol_id").alias("id"), F.round("similarity", 9).alias("similarity")).where("similarity >= 0.1")
    channels = [(lexical, "lexical", "lexical", 1.0), (identity, "identity", "identity", 2.0), (structural, "rank", "structural", 0.4), (near, "similarity", "similarity", 0.8)]
    return R.fuse_channels(R.rank_channels(channels, "id"), "id").select("id", "score")


@REGISTRY.query(
    "ranking_confidence",
    """WITH e AS (SELECT DISTINCT event_id, top1_score AS t1, coalesce(top2_score, 0) AS t2, identity_hit AS ih, repo_is_stale AS st FROM ranking_events WHERE top1_score IS NOT NULL AND NOT isnan(top1_score)),
p AS (SELECT event_id, CASE WHEN t1 > 0 THEN greatest(0e0, least(1e0, (t1 - t2) / t1)) ELSE 0e0 END AS gap, greatest(0e0, least(1e0, 1 - exp(-t1 / 4))) AS strength,
  CASE WHEN ih > 0 THEN 1e0 ELSE 0.6e0 END AS idn, CASE WHEN st > 0 THEN 0.6e0 ELSE 1e0 END AS fresh FROM e)
SELECT event_id, round(exp(0.35e0 * ln(greatest(gap, 1e-6)) + 0.35e0 * ln(greatest(strength, 1e-6)) + 0.15e0 * ln(idn) + 0.15e0 * ln(fresh)), 6) AS confidence FROM p""",
)
def ranking_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each ranking was: gap, strength, identity and freshness in a geometric mean."""
    rows = table(spark, sf_dir, "ranking_events").select("event_id", F.col("top1_score").alias("top1"), F.col("top2_score").alias("top2"), "identity_hit", F.col("repo_is_stale").alias("stale")).distinct()
    return R.with_confidence(rows.where("top1 is not null and not isnan(top1)")).select("event_id", "confidence")


@REGISTRY.query(
    "ledger_features",
    """WITH f AS (SELECT query_id, symbol_id, max(score) AS score, max((map_extract(raw_scores, 'identity')[1] > 0)::INT) AS i FROM fused_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS rk FROM f)
SELECT query_id, max(score) FILTER (rk = 1) AS top1, max(score) FILTER (rk = 2) AS top2, coalesce(max(i) FILTER (rk <= 3), 0) AS identity_hit FROM r WHERE rk <= 3 GROUP BY query_id""",
)
def ledger_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second score of each query and whether identity had a say among the first three."""
    rows = table(spark, sf_dir, "fused_results").where("score is not null and not isnan(score)")
    one = rows.groupBy("query_id", "symbol_id").agg(F.max("score").alias("score"), F.max((F.coalesce(F.col("raw_scores")["identity"], F.lit(0.0)) > 0).cast("int")).alias("i"))
    return R.ledger_features(one, "query_id", "symbol_id", "score", "i")


@REGISTRY.query(
    "ranking_quality",
    """WITH p AS (SELECT query_id, arg_max(returned_ids, event_id) AS ids FROM ranking_events WHERE query_id IS NOT NULL AND returned_ids IS NOT NULL GROUP BY query_id),
x AS (SELECT query_id, unnest((ids::VARCHAR[])[1:10]) AS symbol_id, generate_subscripts((ids::VARCHAR[])[1:10], 1) - 1 AS pos FROM p),
r AS (SELECT query_id, symbol_id, min(pos) AS pos FROM x GROUP BY ALL),
w AS (SELECT DISTINCT query_id, symbol_id FROM fused_results WHERE map_extract(raw_scores, 'identity')[1] > 0),
g AS (SELECT query_id, count(*) AS n, count(pos) AS hits, min(pos) AS first, sum(1e0 / log2(pos + 2)) AS dcg FROM w LEFT JOIN r USING (query_id, symbol_id) GROUP BY query_id)
SELECT query_id, round(coalesce(dcg / list_sum([1e0 / log2(i + 1) for i in range(1, least(n, 10) + 1)]), 0), 6) AS ndcg, round(coalesce(1e0 / (first + 1), 0), 6) AS mrr, round(hits / n, 6) AS recall FROM g""",
)
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG, MRR and recall at 10 of the returned ids against the candidates that identity scored."""
    events = table(spark, sf_dir, "ranking_events").where("query_id is not null and returned_ids is not null")
    predicted = events.groupBy("query_id").agg(F.max_by("returned_ids", "event_id").alias("j")).select("query_id", json_list(F.col("j")).alias("ids"))
    relevant = table(spark, sf_dir, "fused_results").where(F.col("raw_scores")["identity"] > 0)
    return R.ranking_quality(predicted, relevant, "query_id", "symbol_id")


@REGISTRY.query("context_packing")
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each query's candidates fits a budget of bytes, packed greedily with diversity by file."""
    best = table(spark, sf_dir, "fused_results").where("score is not null and not isnan(score)").groupBy("query_id", F.col("symbol_id").alias("id")).agg(F.max("score").alias("score"))
    sized = symbols(spark, sf_dir, "id", "byte_length", "file").groupBy("id").agg(F.max("byte_length").alias("size"), F.min("file").alias("file"))
    joined = best.join(sized, "id").where("size is not null")
    return R.pack_budget(joined, "query_id", "id", "file", "score", "size", 1000)


_KIND = "CASE lower(kind) WHEN 'class' THEN 0 WHEN 'type' THEN 1 WHEN 'function' THEN 2 WHEN 'method' THEN 3 ELSE 4 END"
#: Characters of signatures that a repository's map may have.
MAP_BUDGET = 4_000


@REGISTRY.query(
    "repo_map",
    _RANKED + f""", o AS (SELECT DISTINCT id, file, kind, byte_length, line, signature FROM symbols), q AS (SELECT id, file, length(signature) AS size, row_number() OVER (PARTITION BY file ORDER BY {_KIND}, byte_length DESC NULLS LAST, line NULLS LAST, id) AS place FROM o),
z AS (SELECT q.*, rank, split_part(file, '/', 1) AS repo, coalesce(size, 0) AS cost FROM q JOIN fr USING (file) WHERE place <= 5 AND rank > 0),
y AS (SELECT *, sum(cost) OVER (PARTITION BY repo ORDER BY rank DESC, file, place) AS upto FROM z)
SELECT repo, file, id, place::INTEGER AS place FROM y WHERE upto <= {MAP_BUDGET}""",
)
def repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first symbols of each file by kind, size and line, files by PageRank, as far as the signatures fit each repository's budget."""
    rows = symbols(spark, sf_dir, "id", "file", "kind", "byte_length", "line", "signature")
    order = [F.expr(_KIND), F.desc_nulls_last("byte_length"), F.asc_nulls_last("line"), F.asc("id")]
    first = R.best_per_file(rows, "file", order, 5).join(file_ranks(spark, sf_dir).where("rank > 0"), "file")
    sized = first.withColumn("repo", F.substring_index("file", "/", 1)).withColumn("cost", F.coalesce(F.length("signature"), F.lit(0)))
    return R.fill_budget(sized, "repo", ["-rank", "file", "place"], "cost", MAP_BUDGET).select("repo", "file", "id", "place")


def _intent_sql() -> str:
    cases = []
    for intent, words in sorted(INTENTS.items()):
        w = " + ".join(f"CASE WHEN contains(q, '{x}') THEN {1 + len(x) / 30!r}::DOUBLE ELSE 0e0 END" for x in words)
        n = " + ".join(f"contains(q, '{x}')::INT" for x in words)
        cases.append(f"SELECT event_id, '{intent}' AS intent, round({w}, 6) AS w, {n} AS n FROM e")
    return "WITH e AS (SELECT DISTINCT event_id, lower(coalesce(query, '')) AS q FROM ranking_events), c AS (" + " UNION ALL ".join(cases) + """),
b AS (SELECT event_id, arg_min({'i': intent, 'w': w, 'n': n}, (-w, intent)) AS b FROM c GROUP BY event_id)
SELECT event_id, CASE WHEN b.w = 0 THEN 'general' ELSE b.i END AS intent, CASE WHEN b.w = 0 THEN 0e0 ELSE round(least(0.95e0, 0.55e0 + 0.1e0 * b.n), 4) END AS intent_confidence FROM b"""


@REGISTRY.query("query_intents", _intent_sql())
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of task each query is, by weighted keywords."""
    rows = table(spark, sf_dir, "ranking_events").select("event_id", "query").distinct()
    return R.classify_intent(rows, "query", INTENTS, "general").select("event_id", "intent", "intent_confidence")


@REGISTRY.query(
    "query_suggestions",
    """WITH s AS (SELECT DISTINCT id, kind, language, keywords FROM symbols),
k AS (SELECT 'keyword' AS what, lower(unnest(keywords)) AS value FROM s), a AS (
SELECT * FROM k UNION ALL SELECT 'kind', lower(kind) FROM s UNION ALL SELECT 'language', lower(language) FROM s),
c AS (SELECT what, value, count(*) AS n FROM a WHERE value IS NOT NULL GROUP BY ALL)
SELECT what, value, n, row_number() OVER (PARTITION BY what ORDER BY n DESC, value)::INTEGER AS place FROM c QUALIFY place <= 15""",
)
def query_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent keywords, kinds and languages, as starting points for queries."""
    rows = symbols(spark, sf_dir, "id", "kind", "language", "keywords")
    parts = rows.select(F.explode(F.concat(
        F.array(F.struct(F.lit("kind").alias("what"), F.lower("kind").alias("value")), F.struct(F.lit("language").alias("what"), F.lower("language").alias("value"))),
        F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.struct(F.lit("keyword").alias("what"), F.lower(k).alias("value"))),
    )).alias("p"))
    counts = parts.select("p.what", "p.value").where("value is not null").groupBy("what", "value").agg(F.count("*").alias("n"))
    return R.best_per_file(counts, "what", [F.desc("n"), F.asc("value")], 15)


@REGISTRY.query(
    "related_symbols",
    """WITH s AS (SELECT DISTINCT id, file, name FROM symbols), t AS (SELECT * FROM s WHERE id = (SELECT min(symbol_id) FROM probe_symbols)),
k AS (SELECT id, file, list_distinct(regexp_extract_all(lower(regexp_replace(coalesce(name, ''), '([a-z])([A-Z])', '\\1_\\2', 'g')), '[a-z0-9]{2,}')) AS w FROM s)"""
    + _IMPORTED
    + """, co AS (SELECT DISTINCT b.dst AS file FROM im a JOIN im b ON a.src = b.src WHERE a.dst IN (SELECT file FROM t))
SELECT k.id, (CASE WHEN k.file = t.file THEN 3e0 WHEN k.file IN (SELECT file FROM co) THEN 1.5e0 ELSE 0e0 END + 0.5e0 * len(list_intersect(k.w, tk.w))) AS score FROM k, t JOIN k tk ON tk.id = t.id
WHERE k.id <> t.id AND (k.file = t.file OR k.file IN (SELECT file FROM co) OR len(list_intersect(k.w, tk.w)) > 0)""",
)
def related_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols related to one: in its file, in a file that one importer of its file imports too, or by the words of its name."""
    rows = symbols(spark, sf_dir, "id", "file", "name")
    words = rows.select("id", "file", F.array_distinct(raw_tokens(F.col("name"))).alias("w"))
    first = table(spark, sf_dir, "probe_symbols").agg(F.min("symbol_id").alias("id"))
    one = words.join(first, "id").select(F.col("id").alias("tid"), F.col("file").alias("tfile"), F.col("w").alias("tw"))
    e = Cuts(spark).cut(import_edges(spark, sf_dir))
    importers = e.join(one.select(F.col("tfile").alias("dst")), "dst", "left_semi").select("src")
    co = e.join(importers, "src", "left_semi").select(F.col("dst").alias("file"), F.lit(True).alias("co")).distinct()
    shared = F.size(F.array_intersect("w", "tw"))
    place = F.when(F.col("file") == F.col("tfile"), 3.0).when(F.col("co"), 1.5).otherwise(0.0)
    near = words.join(co, "file", "left").crossJoin(F.broadcast(one)).where((F.col("id") != F.col("tid")) & ((place > 0) | (shared > 0)))  # one row
    return near.select("id", (place + 0.5 * shared).alias("score"))


@REGISTRY.query(
    "turn_plan",
    _BAG + """, h AS (SELECT count(*) AS hits, max(round(lexical, 6)) AS top FROM lex)
SELECT hits, top, CASE WHEN hits = 0 THEN 'none' WHEN top >= 8 AND hits >= 3 THEN 'high' WHEN top >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM h""",
)
def turn_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols a query hits, how well, and how sure one may be of them."""
    h = R.bm25(_ranked(spark, sf_dir), TERMS).agg(F.count("*").alias("hits"), F.max(F.round("lexical", 6)).alias("top"))
    sure = F.when(F.col("hits") == 0, "none").when((F.col("top") >= 8) & (F.col("hits") >= 3), "high").when(F.col("top") >= 3, "medium").otherwise("low")
    return h.withColumn("confidence", sure)


@REGISTRY.query(
    "context_bundle",
    """WITH p AS (SELECT DISTINCT symbol_id AS id FROM probe_symbols), s AS (SELECT DISTINCT s.id, s.file, s.byte_length FROM symbols s JOIN p USING (id)),
f AS (SELECT DISTINCT path, imports FROM files WHERE regexp_matches(imports, '\\]\\s*$')), i AS (SELECT DISTINCT path, unnest(from_json(imports, '[{"specifier":"VARCHAR"}]')).specifier AS sp FROM f), g AS (SELECT path, string_agg(sp, ',' ORDER BY sp) AS imports FROM i GROUP BY path)
SELECT id, file, byte_length, g.imports FROM s LEFT JOIN g ON s.file = g.path""",
)
def context_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols asked about with the imports of their files, each once."""
    asked = table(spark, sf_dir, "probe_symbols").select(F.col("symbol_id").alias("id")).distinct()
    s = symbols(spark, sf_dir, "id", "file", "byte_length").join(asked, "id", "left_semi")
    f = table(spark, sf_dir, "files").select("path", "imports").where(F.col("imports").rlike(r"\]\s*$")).distinct()
    i = f.select(F.col("path").alias("file"), F.explode(F.from_json("imports", "array<struct<specifier:string>>")).alias("i")).select("file", F.col("i.specifier").alias("sp")).distinct()
    return s.join(i.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("sp")), ",").alias("imports")), "file", "left").select("id", "file", "byte_length", "imports")

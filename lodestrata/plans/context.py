"""Queries of references, histories and contexts around symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import clamp
from ..operators import context as C
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import snapshots as S
from ..operators.resolve import by_stem
from ..session import Cuts
from ..sources.extract import hashed_vector
from ..sources.scan import admission
from ..sources.telemetry import sql_tables
from ..tables import table
from .code import imports, symbols, texts
from .graphs import _CALLS, _CODE, _IMPORTED, _WAYS, class_edges, code_graph, file_ranks, gateways, import_edges, name_members
from .ranking import INTENTS, _intent_sql
from .registry import Registry

REGISTRY = Registry()
#: the repository that is held against the others
MONO = "orbit-mono"

_VERSIONS = f"""WITH s AS (SELECT DISTINCT id, split_part(file, '/', 1) = '{MONO}' AS mono, name, lower(kind) AS kind, coalesce(content_hash, signature) AS c FROM symbols WHERE name IS NOT NULL AND kind IS NOT NULL AND id IS NOT NULL AND file IS NOT NULL),
a AS (SELECT name, kind, min((id, c))[2] AS c FROM s WHERE NOT mono GROUP BY ALL), b AS (SELECT name, kind, min((id, c))[2] AS c FROM s WHERE mono GROUP BY ALL),
d AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.kind, b.kind) AS kind, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.c IS NOT DISTINCT FROM b.c THEN 'unchanged' ELSE 'changed' END AS status, a.c AS ac, b.c AS bc FROM a FULL JOIN b ON a.name = b.name AND a.kind = b.kind)
"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "symbols").where("name is not null and kind is not null and id is not null and file is not null")
    named = rows.select("id", (F.substring_index("file", "/", 1) == MONO).alias("mono"), "name", F.lower("kind").alias("kind"), F.coalesce("content_hash", "signature").alias("c"))
    first = Cuts(spark).cut(named.groupBy("mono", "name", "kind").agg(F.min(F.struct("id", "c")).alias("b")).select("mono", "name", "kind", "b.c"))
    return first.where("not mono").drop("mono"), first.where("mono").drop("mono")


@REGISTRY.query("symbol_diff", _VERSIONS + "SELECT name, kind, status FROM d")
def symbol_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of one repository against those of all others by name and kind, the first of each, by content or signature."""
    return S.snapshot_diff(*_versions(spark, sf_dir), ["name", "kind"], "c")


@REGISTRY.query(
    "symbol_renames",
    _VERSIONS + """, r AS (SELECT ac AS c, min(name) AS name, min(kind) AS kind FROM d WHERE status = 'removed' AND ac IS NOT NULL GROUP BY ac HAVING count(*) = 1), n AS (SELECT bc AS c, min(name) AS name, min(kind) AS kind FROM d WHERE status = 'added' AND bc IS NOT NULL GROUP BY bc HAVING count(*) = 1)
SELECT r.name AS old_name, r.kind AS old_kind, n.name AS new_name, n.kind AS new_kind FROM r JOIN n USING (c)""",
)
def symbol_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that only one side has, under another name on the other side with the same content."""
    old, new = _versions(spark, sf_dir)
    diff = Cuts(spark).cut(S.snapshot_diff(old, new, ["name", "kind"], "c"))
    return S.renames(diff, old, new, ["name", "kind"], "c").select("old_name", "old_kind", "new_name", "new_kind")


@REGISTRY.query("file_importers", _CALLS + _IMPORTED + "SELECT path, count(src) AS importers, count(src) > 0 AS has_importers FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) LEFT JOIN im ON im.dst = path GROUP BY path")
def file_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files import each file."""
    n = import_edges(spark, sf_dir).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "files").select("path").where("path is not null").distinct().join(n, "path", "left")
    return rows.select("path", F.coalesce("n", F.lit(0)).alias("importers"), F.col("n").isNotNull().alias("has_importers"))


@REGISTRY.query(
    "name_references",
    """WITH f AS (SELECT DISTINCT path, imports FROM files WHERE regexp_matches(imports, '\\]\\s*$')), i AS (SELECT path, unnest(from_json(imports, '[{"specifier":"VARCHAR","names":["VARCHAR"]}]')) AS i FROM f),
a AS (SELECT path, lower(unnest(i.names)) AS name, 0 AS o FROM i UNION ALL SELECT path, lower(regexp_extract(i.specifier, '[^/]*$')), 1 FROM i),
p AS (SELECT DISTINCT lower(name) AS name FROM symbols WHERE id IN (SELECT symbol_id FROM probe_symbols) AND name IS NOT NULL)
SELECT name, path AS importer, CASE min(o) WHEN 0 THEN 'name' ELSE 'stem' END AS how FROM a JOIN p USING (name) GROUP BY ALL""",
)
def name_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that import a name of the symbols asked about, by that name or as the end of a specifier."""
    rows = imports(spark, sf_dir)
    entry = lambda name, o: F.struct(F.lower(name).alias("name"), F.lit(o).alias("o"))
    every = F.concat(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: entry(n, 0)), F.array(entry(F.substring_index("specifier", "/", -1), 1)))
    each = rows.select("importer", F.explode(every).alias("e")).select("importer", "e.name", "e.o")
    asked = table(spark, sf_dir, "symbols").join(table(spark, sf_dir, "probe_symbols").select(F.col("symbol_id").alias("id")), "id", "left_semi").select(F.lower("name").alias("name")).distinct()
    hit = each.join(asked, "name").groupBy("name", "importer").agg(F.min("o").alias("o"))
    return hit.select("name", "importer", F.when(F.col("o") == 0, "name").otherwise("stem").alias("how"))


@REGISTRY.query("rename_edits", "WITH t AS (SELECT DISTINCT path, content FROM file_texts WHERE content IS NOT NULL), l AS (SELECT path, unnest(string_split(content, chr(10))) AS before, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line FROM t) SELECT path, line, before, regexp_replace(before, '\\bsymbol\\b', 'entity', 'g') AS after FROM l WHERE regexp_matches(before, '\\bsymbol\\b')")
def rename_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all files that a rename would change, before and after."""
    return C.rename_edits(texts(spark, sf_dir), "path", "content", "symbol", "entity")


_HIERARCHY = _CALLS + """, g AS (SELECT repo, name, min(callee) AS class FROM nm GROUP BY ALL), k AS (SELECT nm.callee AS id, g.class FROM nm JOIN g ON nm.repo = g.repo AND nm.name = g.name),
ek AS (SELECT DISTINCT k.class AS src, g.class AS dst FROM cl JOIN g ON cl.repo = g.repo AND cl.name = g.name JOIN k ON cl.caller = k.id WHERE k.class <> g.class),
r AS (SELECT DISTINCT k.class AS id FROM k WHERE id IN (SELECT symbol_id FROM probe_symbols)),
w(seed, class, level) AS (SELECT id, id, 0 FROM r UNION SELECT w.seed, ek.dst, w.level + 1 FROM w JOIN ek ON ek.src = w.class WHERE w.level < 3),
u(seed, class, level) AS (SELECT id, id, 0 FROM r UNION SELECT u.seed, ek.src, u.level - 1 FROM u JOIN ek ON ek.dst = u.class WHERE u.level > -3)
SELECT seed, class, min(level)::INTEGER AS level FROM w WHERE class <> seed GROUP BY ALL UNION ALL SELECT seed, class, max(level)::INTEGER FROM u WHERE class <> seed GROUP BY ALL"""


@REGISTRY.query("call_hierarchy", _HIERARCHY)
def call_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the symbols asked about call (level > 0) and what calls them (level < 0), up to three calls on, as classes of names (`name_members`)."""
    cuts = Cuts(spark)
    e = cuts.cut(class_edges(spark, sf_dir))
    asked = name_members(spark, sf_dir).join(table(spark, sf_dir, "probe_symbols").select(F.col("symbol_id").alias("id")), "id", "left_semi")
    seeds = cuts.cut(asked.select(F.col("class").alias("id")).distinct())
    down, up = G.bfs(e, seeds, 3), G.bfs(G.invert(e), seeds, 3)
    return down.unionByName(up.withColumn("level", -F.col("level"))).where("level <> 0").select("seed", F.col("id").alias("class"), "level")


@REGISTRY.query(
    "reachable_files",
    _CODE + f""", {_WAYS}, rt AS (SELECT DISTINCT file FROM symbols WHERE id IN (SELECT id FROM gw WHERE gateway IS NOT NULL)), un AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce),
rc(id) AS (SELECT file FROM rt WHERE file IS NOT NULL UNION SELECT un.dst FROM rc JOIN un ON un.src = rc.id)
SELECT id AS file, id IN (SELECT id FROM rc) AS reachable FROM cn WHERE NOT contains(id, '#')""",
)
def reachable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each file is connected, forward or backward, to a file with a way in."""
    edges, nodes = code_graph(spark, sf_dir)
    parts = Cuts(spark).cut(G.components(edges, nodes))
    ways = table(spark, sf_dir, "symbols").select("id", "file").join(gateways(spark, sf_dir).select("id"), "id", "left_semi").select(F.col("file").alias("id")).distinct()
    live = parts.join(ways, "id", "left_semi").select("component").distinct().withColumn("hit", F.lit(True))
    return parts.where(~F.contains("id", F.lit("#"))).join(live, "component", "left").select(F.col("id").alias("file"), F.coalesce("hit", F.lit(False)).alias("reachable"))


@REGISTRY.query(
    "pooled_vectors",
    """WITH e AS (SELECT DISTINCT symbol_id, embedding::DOUBLE[] AS v FROM symbol_embeddings WHERE len(embedding) = 16), s AS (SELECT DISTINCT id, file FROM symbols WHERE file IS NOT NULL),
x AS (SELECT file, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e JOIN s ON symbol_id = id), m AS (SELECT file, i, avg(x) AS m FROM x GROUP BY ALL), n AS (SELECT file, sqrt(sum(m * m)) AS n FROM m GROUP BY file)
SELECT file, i::INTEGER AS at, round(m / n, 6) + 0e0 AS value FROM m JOIN n USING (file)""",
)
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of the symbols of each file, scaled to length one, place by place."""
    e = table(spark, sf_dir, "symbol_embeddings").select("symbol_id", "embedding").where("size(embedding) = 16").distinct()
    s = symbols(spark, sf_dir, "id", "file").where("file is not null")
    pooled = C.mean_vectors(e.join(s, F.col("symbol_id") == F.col("id")), "file", "embedding")
    return pooled.select("file", F.posexplode("vector").alias("at", "value")).select("file", (F.col("at") + 1).alias("at"), (F.round("value", 6) + 0.0).alias("value"))


@REGISTRY.query("hashed_vectors")
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the symbols' names and summaries without a model, by hashed trigrams."""
    s = symbols(spark, sf_dir, "id", "name", "summary").where("id is not null")
    return s.select("id", hashed_vector(F.concat_ws(" ", "name", "summary")).alias("vector"))


@REGISTRY.query(
    "enriched_keywords",
    """WITH s AS (SELECT DISTINCT id, file, keywords FROM symbols WHERE id IS NOT NULL), c AS (SELECT path, lower(language) AS tag FROM files WHERE language IS NOT NULL UNION SELECT path, split_part(path, '/', 2) FROM files WHERE contains(path, '/')),
t AS (SELECT path, list(tag) AS tags FROM c GROUP BY path)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(keywords, []), coalesce(tags, [])))), ',') AS keywords FROM s LEFT JOIN t ON file = path""",
)
def enriched_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of the symbols with what two providers say of their files: the language and the top directory."""
    f = table(spark, sf_dir, "files").select("path", "language").distinct()
    tags = f.select(F.col("path").alias("file"), F.array(F.lower("language"), F.when(F.contains("path", F.lit("/")), F.split("path", "/")[1])).alias("tags"))
    rows = C.enrich(symbols(spark, sf_dir, "id", "file", "keywords").where("id is not null"), tags)
    return rows.select("id", F.array_join(F.array_sort(F.array_distinct("keywords")), ",").alias("keywords"))


@REGISTRY.query(
    "contract_stability",
    """WITH f AS (SELECT DISTINCT path, imports FROM files WHERE regexp_matches(imports, '\\]\\s*$')), i AS (SELECT path, unnest(from_json(imports, '[{"names":["VARCHAR"]}]')).names AS names FROM f), u AS (SELECT DISTINCT unnest(names) AS name, split_part(path, '/', 1) AS member FROM i),
x AS (SELECT name, min(split_part(file, '/', 1)) AS owner FROM symbols WHERE name IS NOT NULL AND file IS NOT NULL GROUP BY name HAVING count(DISTINCT split_part(file, '/', 1)) = 1),
h AS (SELECT file, count(DISTINCT branch) AS n FROM branch_deltas GROUP BY file), c AS (SELECT name, sum(coalesce(n, 0)) AS churn FROM (SELECT DISTINCT name, file FROM symbols WHERE name IS NOT NULL AND file IS NOT NULL) LEFT JOIN h USING (file) GROUP BY name),
o AS (SELECT u.name, count(*) AS importers FROM u JOIN x USING (name) WHERE member <> owner GROUP BY u.name)
SELECT name, owner, coalesce(importers, 0) AS importers, churn::BIGINT AS churn, round(greatest(0.1e0, 1 - 0.3e0 * ln(1 + churn)), 6) AS stability, CASE WHEN importers IS NULL THEN 'dead' ELSE 'used' END AS verdict FROM x JOIN c USING (name) LEFT JOIN o USING (name)""",
)
def contract_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one repository alone has: how many others import them, how often their files change, and whether none does."""
    repo = lambda c: F.substring_index(c, "/", 1)
    named = symbols(spark, sf_dir, "name", "file").where("name is not null and file is not null")
    owned = named.groupBy("name").agg(F.min(repo("file")).alias("owner"), F.count_distinct(repo("file")).alias("n")).where("n = 1").drop("n")
    churn = table(spark, sf_dir, "branch_deltas").groupBy("file").agg(F.count_distinct("branch").alias("n"))
    changes = named.join(churn, "file", "left").groupBy("name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("churn"))
    used = imports(spark, sf_dir).select(F.explode("names").alias("name"), repo("importer").alias("member")).distinct()
    outer = used.join(owned, "name").where("member <> owner").groupBy("name").agg(F.count("*").alias("importers"))
    j = owned.join(changes, "name").join(outer, "name", "left")
    stability = clamp(1 - 0.3 * F.log1p("churn"), 0.1, 1.0)
    return j.select("name", "owner", F.coalesce("importers", F.lit(0)).alias("importers"), "churn", F.round(stability, 6).alias("stability"), F.when(F.col("importers").isNull(), "dead").otherwise("used").alias("verdict"))


@REGISTRY.query(
    "table_symbols",
    """WITH d AS (SELECT DISTINCT text FROM documents WHERE source = 'code' AND text IS NOT NULL), n AS (SELECT unnest(regexp_extract_all(text, '(?i)\\b(?:from|join|into|update|table)\\s+"?((?:\\w+"?\\.")*"?(?:\\w+"?\\.)*\\w+)', 1)) AS n FROM d),
t AS (SELECT DISTINCT lower(regexp_extract(replace(n, '"', ''), '[^.]*$')) AS name FROM n), s AS (SELECT DISTINCT id, file, lower(name) AS name FROM symbols WHERE id IS NOT NULL)
SELECT t.name, id FROM t JOIN s ON s.name = t.name UNION SELECT t.name, id FROM t JOIN s ON lower(regexp_replace(regexp_extract(file, '[^/]*$'), '[.][^.]*$', '')) = t.name""",
)
def table_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that the tables named in statements mean, by the name of their file or by their own."""
    code = table(spark, sf_dir, "documents").where("source = 'code' and text is not null").select("text")
    names = code.select(F.explode(sql_tables(F.col("text"))).alias("name")).distinct()
    s = symbols(spark, sf_dir, "id", "file", "name").where("id is not null")
    own = names.join(s.select("id", F.lower("name").alias("name")), "name")
    files = by_stem(names, "name", s.select(F.col("file").alias("path"))).join(s.select("id", F.col("file").alias("path")), "path")
    return own.select("name", "id").unionByName(files.select("name", "id")).distinct()


@REGISTRY.query(
    "listing_changes",
    """WITH f AS (SELECT path, max(size_bytes) AS s, max(blob_sha) AS sha FROM files GROUP BY path), a AS (SELECT path, sha FROM f WHERE NOT regexp_matches(path, '(?:^|/)(?:node_modules|\\.git|__pycache__|venv|\\.venv|dist|build|\\.tox|\\.mypy_cache|target|vendor)/') AND regexp_matches(path, '[.](py|jsx?|tsx?|go|java)$') AND s <= 512000),
b AS (SELECT file AS path, max(file_hash) AS sha FROM branch_deltas WHERE file IS NOT NULL GROUP BY file)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.sha IS NOT DISTINCT FROM b.sha THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path""",
)
def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing of a remote tree has for an index to read: its admitted files by their digests, against those known."""
    f = table(spark, sf_dir, "files").where("path is not null").groupBy("path").agg(F.max("size_bytes").alias("size"), F.max("blob_sha").alias("sha"))
    tree = f.where(admission(F.col("path"), F.col("size")).isNull()).select("path", "sha")
    known = table(spark, sf_dir, "branch_deltas").where("file is not null").groupBy(F.col("file").alias("path")).agg(F.max("file_hash").alias("sha"))
    return S.snapshot_diff(known, tree, ["path"], "sha")


@REGISTRY.query(
    "task_context",
    _intent_sql().replace("SELECT event_id, CASE WHEN b.w = 0", ", it AS (SELECT event_id, CASE WHEN b.w = 0", 1)
    + """), tk AS (SELECT DISTINCT event_id, unnest(regexp_extract_all(q, '[a-z0-9_]+')) AS name FROM e), nm AS (SELECT lower(name) AS name, count(DISTINCT id) AS n, min(id) AS first FROM symbols WHERE name IS NOT NULL GROUP BY 1),
an AS (SELECT event_id, count(*) AS anchors, sum(n)::BIGINT AS candidates, min(first) AS first FROM tk JOIN nm USING (name) GROUP BY event_id)
SELECT event_id, intent, coalesce(anchors, 0) AS anchors, coalesce(candidates, 0) AS candidates, first FROM it LEFT JOIN an USING (event_id)""",
)
def task_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query its intent, how many of its words are names of symbols, how many symbols these are, and the first."""
    events = table(spark, sf_dir, "ranking_events").select("event_id", "query").distinct()
    words = events.select("event_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit("[a-z0-9_]+"), 0))).alias("name")).distinct()
    named = symbols(spark, sf_dir, "id", "name").where("name is not null").groupBy(F.lower("name").alias("name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"))
    anchors = words.join(named, "name").groupBy("event_id").agg(F.count("*").alias("anchors"), F.sum("n").alias("candidates"), F.min("first").alias("first"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return R.classify_intent(events, "query", INTENTS, "general").join(anchors, "event_id", "left").select("event_id", "intent", zero("anchors"), zero("candidates"), "first")


@REGISTRY.query("bundle_packing")
def bundle_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the symbols asked about fit each repository's budget of bytes, by the PageRank of their files, ways in first."""
    asked = table(spark, sf_dir, "probe_symbols").select(F.col("symbol_id").alias("id")).distinct()
    s = symbols(spark, sf_dir, "id", "file", "byte_length").join(asked, "id", "left_semi").groupBy("id").agg(F.min("file").alias("file"), F.max("byte_length").alias("size"))
    ways = gateways(spark, sf_dir).select("id", F.lit(True).alias("way")).distinct()
    rows = s.join(file_ranks(spark, sf_dir), "file", "left").join(ways, "id", "left").withColumn("repo", F.substring_index("file", "/", 1))
    return C.bundle(rows, "repo", "id", "size", "rank", F.col("way").isNotNull(), 2_000, "core_first")

"""Graph queries: over the flow of goods between nations, and over code by its imports, calls and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.resolve import ENDINGS, SCRIPT_ENDINGS, base_names, resolve_specifiers
from ..operators.snapshots import first_per_key
from ..session import Cuts
from ..tables import table
from .registry import Registry

REGISTRY = Registry()

_FLOW = """
WITH RECURSIVE f AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, round(sum(l_extendedprice), 2) AS revenue
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT src, dst, revenue FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY revenue DESC, dst) <= 3),
e AS (SELECT DISTINCT src, dst FROM g WHERE src <> dst),
n AS (SELECT n_nationkey AS id FROM nation)
"""


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, revenue: the three nations each nation's suppliers sell most to."""
    t = lambda name, *cols: table(spark, sf_dir, name).select(*cols)
    sold = (
        t("lineitem", "l_suppkey", "l_orderkey", "l_extendedprice")
        .join(t("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    )
    pairs = sold.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return first_per_key(pairs, ["src"], [F.desc("revenue"), F.asc("dst")], 3)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))


@REGISTRY.query("graph_degrees", _FLOW + "SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree FROM n")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges out of and into every node."""
    return G.degrees(flow(spark, sf_dir), nations(spark, sf_dir))


@REGISTRY.query(
    "graph_coupling",
    _FLOW + """, d AS (SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS ca, (SELECT count(*) FROM e WHERE src = id) AS ce FROM n),
i AS (SELECT *, CASE WHEN ca + ce > 0 THEN round(ce / (ca + ce), 4) END AS instability FROM d)
SELECT *, CASE WHEN instability IS NULL THEN 'isolated' WHEN instability > 0.7e0 THEN 'unstable' WHEN instability >= 0.3e0 THEN 'balanced' ELSE 'stable' END AS band FROM i""",
)
def graph_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Afferent and efferent coupling and instability."""
    return G.coupling(flow(spark, sf_dir), nations(spark, sf_dir))


_BFS = _FLOW + """, b(id, level) AS (
  SELECT id, 0 FROM n WHERE id = {seed} UNION ALL SELECT e.{to}, b.level + 1 FROM b JOIN e ON e.{of} = b.id WHERE b.level < {depth})
SELECT {seed} AS seed, id, min(level)::INTEGER AS level FROM b GROUP BY id"""


@REGISTRY.query("graph_khop", _BFS.format(seed=3, of="src", to="dst", depth=3))
def graph_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes within three steps of one, with their first level."""
    return G.bfs(flow(spark, sf_dir), nations(spark, sf_dir).where("id = 3"), 3)


@REGISTRY.query("graph_blast_radius", _BFS.format(seed=11, of="dst", to="src", depth=4))
def graph_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on a node, by depth."""
    return G.bfs(G.invert(flow(spark, sf_dir)), nations(spark, sf_dir).where("id = 11"), 4)


@REGISTRY.query(
    "graph_impact_paths",
    _FLOW + """, b(id, level, path) AS (
  SELECT id, 0, [id] FROM n WHERE id = 11 UNION ALL SELECT e.src, b.level + 1, list_append(b.path, e.src) FROM b JOIN e ON e.dst = b.id WHERE b.level < 5 AND NOT list_contains(b.path, e.src)),
m AS (SELECT id, min(level) AS level FROM b GROUP BY id)
SELECT b.id, b.level::INTEGER AS level, array_to_string(min(path), '>') AS path FROM b JOIN m ON b.id = m.id AND b.level = m.level GROUP BY ALL""",
)
def graph_impact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on a node, each with its smallest shortest path."""
    found = G.bfs(G.invert(flow(spark, sf_dir)), nations(spark, sf_dir).where("id = 11"), 5, carry=True)
    return found.select("id", "level", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@REGISTRY.query(
    "graph_reachable",
    _FLOW + """, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), b(id) AS (SELECT id FROM n WHERE id IN (1, 2) UNION SELECT u.dst FROM b JOIN u ON u.src = b.id),
d(id) AS (SELECT id FROM n WHERE id IN (1, 2) UNION SELECT e.dst FROM d JOIN e ON e.src = d.id)
SELECT id, (id IN (SELECT id FROM b)) AS connected, (id IN (SELECT id FROM d)) AS reachable FROM n""",
)
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes entries reach along the edges, and which they are connected to either way."""
    edges, ids = flow(spark, sf_dir), nations(spark, sf_dir)
    entries = ids.where("id in (1, 2)")
    flag = lambda e, name: G.bfs(e, entries).select("id", F.lit(True).alias(name)).distinct()
    no = F.lit(False)
    out = ids.join(flag(G.undirected(edges), "connected"), "id", "left").join(flag(edges, "reachable"), "id", "left")
    return out.select("id", F.coalesce("connected", no).alias("connected"), F.coalesce("reachable", no).alias("reachable"))


_SCC = _FLOW + """, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
m AS (SELECT x.a AS id, least(min(x.b), x.a) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
"""


@REGISTRY.query("graph_cycles", _SCC + "SELECT id, component FROM m")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of two nodes or more."""
    return G.strong_components(flow(spark, sf_dir))


@REGISTRY.query("graph_cycle_report", _SCC + "SELECT component, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM m GROUP BY component")
def graph_cycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and members of each."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return G.strong_components(flow(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("size"), members.alias("members"))


@REGISTRY.query(
    "graph_pagerank",
    _FLOW + """, deg AS (SELECT src, count(*) AS deg FROM e GROUP BY src),
pr(i, id, score) AS (
  SELECT 0, id, 1e0 / (SELECT count(*) FROM n) FROM n
  UNION ALL
  SELECT x.i + 1, x.id, 0.15e0 / (SELECT count(*) FROM n) + 0.85e0 * (x.got + x.lost / (SELECT count(*) FROM n)) FROM (
    SELECT p.i, n.id, sum(CASE WHEN e.dst = n.id THEN p.score / deg.deg ELSE 0e0 END) AS got,
      sum(CASE WHEN deg.deg IS NULL THEN p.score / 1 ELSE 0e0 END) AS lost
    FROM n, pr p LEFT JOIN deg ON deg.src = p.id LEFT JOIN e ON e.src = p.id WHERE p.i < 20 GROUP BY p.i, n.id) x)
SELECT id, round(score, 6) AS score FROM pr WHERE i = 20""",
)
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank after 20 rounds."""
    ranks = G.pagerank(flow(spark, sf_dir), nations(spark, sf_dir), rounds=20, tolerance=0.0)
    return ranks.select("id", F.round("score", 6).alias("score"))


_DUPES = "WITH d AS (SELECT DISTINCT doc_id, md5(text) AS h FROM documents WHERE text <> ''), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS component FROM d)"


@REGISTRY.query("graph_components", _DUPES + " SELECT doc_id AS id, component FROM c WHERE component IN (SELECT component FROM c GROUP BY component HAVING count(*) > 1)")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that are linked by equal texts, each document linked to the first of its text."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.md5("text").alias("h")).distinct()
    first = docs.groupBy("h").agg(F.min("doc_id").alias("dst"))
    return G.components(docs.join(first, "h").select(F.col("doc_id").alias("src"), "dst"))


# Calls go by name. A call means surely what its own file or a file that it imports has of that name; else it may mean
# every symbol of the name in the repository. Such a class is kept as one node, so a name that many call and many
# have makes as many rows as calls and symbols, never their product.
_CALLS = """
WITH RECURSIVE s AS (SELECT DISTINCT id, file, name, split_part(file, '/', 1) AS repo, call_references FROM symbols),
cl AS (SELECT DISTINCT id AS caller, file AS src, repo, unnest(call_references) AS name FROM s),
nm AS (SELECT DISTINCT repo, name, id AS callee, file AS dst FROM s WHERE name IS NOT NULL),
us AS (SELECT repo, name, src, count(*) AS n FROM cl WHERE name IS NOT NULL AND src IS NOT NULL GROUP BY ALL),
ug AS (SELECT repo, name, count(*) AS files, count(*) FILTER (regexp_matches('/' || src, '/(tests?|__tests__)/')) AS tests, sum(n) AS callers FROM us GROUP BY ALL),
uses AS (SELECT callee AS id, dst AS file, nm.name, coalesce(o.n, 0) AS own, coalesce(files, 0) - (o.n IS NOT NULL)::INT AS files, coalesce(callers, 0) - coalesce(o.n, 0) AS callers,
  coalesce(tests, 0) - (o.n IS NOT NULL AND regexp_matches('/' || dst, '/(tests?|__tests__)/'))::INT AS tests, coalesce(tests, 0) AS all_tests
  FROM nm LEFT JOIN ug ON nm.repo = ug.repo AND nm.name = ug.name LEFT JOIN us o ON nm.repo = o.repo AND nm.name = o.name AND nm.dst = o.src)
"""
_IMPORTED = """, fi AS (SELECT DISTINCT path, imports FROM files WHERE regexp_matches(imports, '\\]\\s*$')), sp AS (SELECT DISTINCT path AS importer, unnest(from_json(imports, '[{"specifier":"VARCHAR"}]')).specifier AS specifier FROM fi),
ca AS (SELECT importer, specifier, regexp_replace(importer, '/[^/]*$', '') || substring(specifier, 2) AS base FROM sp WHERE specifier LIKE './%'),
ed(o, ending) AS (VALUES """ + ", ".join(f"({i}, '{x}')" for i, x in enumerate(["", *ENDINGS, *("/index" + y for y in SCRIPT_ENDINGS), "/__init__.py"])) + """),
im AS (SELECT DISTINCT importer AS src, path AS dst FROM (SELECT importer, specifier, arg_min(base || ending, o) AS path FROM ca, ed WHERE base || ending IN (SELECT path FROM files) GROUP BY ALL) WHERE importer <> path)
"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, name, callee, dst: the symbols by their name, with their files."""
    rows = table(spark, sf_dir, "symbols").select(F.substring_index("file", "/", 1).alias("repo"), "name", F.col("id").alias("callee"), F.col("file").alias("dst"))
    return rows.where("name is not null").distinct()


def calls_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, src, repo, name: each name that a symbol calls, once."""
    rows = table(spark, sf_dir, "symbols").select(F.col("id").alias("caller"), F.col("file").alias("src"), F.substring_index("file", "/", 1).alias("repo"), F.explode("call_references").alias("name"))
    return rows.where("name is not null").distinct()


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: files and the files that they import, from the specifiers."""
    from .code import imports

    found = resolve_specifiers(imports(spark, sf_dir), table(spark, sf_dir, "files").select("path"))
    return G.simple_edges(found.select(F.col("importer").alias("src"), F.col("path").alias("dst")))


def sure_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, name, callee, src, dst, resolution: calls into the caller's own file and into files that it imports."""
    calls, named = calls_by_name(spark, sf_dir), _named(spark, sf_dir)
    own = calls.join(named.withColumn("src", F.col("dst")), ["repo", "name", "src"]).withColumn("resolution", F.lit("resolved"))
    far = calls.join(import_edges(spark, sf_dir), "src").join(named.drop("repo"), ["dst", "name"]).withColumn("resolution", F.lit("imported"))
    cols = ["caller", "name", "callee", "src", "dst", "resolution"]
    return own.select(*cols).unionByName(far.select(*cols))


def name_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, name, representative, members: the symbols of one name in a repository as one class."""
    return _named(spark, sf_dir).groupBy("repo", "name").agg(F.min("callee").alias("representative"), F.count("*").alias("members"))


def name_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, name, dst: the files that have a symbol of a name."""
    return _named(spark, sf_dir).select("repo", "name", "dst").distinct()


def symbol_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file, name, own, files, tests, callers, all_tests: what calls a symbol, sure or not, as counts.

    own are callers in its file, files and tests the other files that call its name and those of them that are
    tests, callers the symbols in these; all_tests takes its own file in. Each call is counted by name before it
    meets the symbols, so the join is on a unique side.
    """
    test = lambda c: F.concat(F.lit("/"), F.col(c)).rlike(r"/(?:tests?|__tests__)/")
    by_file = calls_by_name(spark, sf_dir).where("src is not null").groupBy("repo", "name", "src").agg(F.count("*").alias("n"))
    by_name = by_file.groupBy("repo", "name").agg(F.count("*").alias("f"), F.count_if(test("src")).alias("t"), F.sum("n").alias("c"))
    rows = _named(spark, sf_dir).join(by_name, ["repo", "name"], "left").join(by_file.select("repo", "name", F.col("src").alias("dst"), "n"), ["repo", "name", "dst"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    here = F.col("n").isNotNull()
    return rows.select(
        F.col("callee").alias("id"), F.col("dst").alias("file"), "name", zero("n").alias("own"), (zero("f") - here.cast("int")).alias("files"), (zero("c") - zero("n")).alias("callers"),
        (zero("t") - (here & test("dst")).cast("int")).alias("tests"), zero("t").alias("all_tests"),
    )


@REGISTRY.query(
    "call_graph",
    _CALLS + _IMPORTED + """, x AS (SELECT cl.caller, cl.name, nm.callee, 'resolved' AS resolution FROM cl JOIN nm ON cl.repo = nm.repo AND cl.name = nm.name AND cl.src = nm.dst
  UNION ALL SELECT cl.caller, cl.name, nm.callee, 'imported' FROM cl JOIN im ON cl.src = im.src JOIN nm ON nm.dst = im.dst AND nm.name = cl.name),
k AS (SELECT caller, name, count(*) AS m FROM x GROUP BY ALL), g AS (SELECT repo, name, min(callee) AS callee, count(*) AS n FROM nm GROUP BY ALL)
SELECT caller, callee, resolution, 1 AS candidates FROM x
UNION ALL SELECT cl.caller, g.callee, 'inferred', n - coalesce(m, 0) FROM cl JOIN g ON cl.repo = g.repo AND cl.name = g.name LEFT JOIN k ON cl.caller = k.caller AND cl.name = k.name WHERE n > coalesce(m, 0)""",
)
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee, resolution, candidates: 'resolved' in the caller's file, 'imported' in a file that it imports, else
    'inferred'. An inferred row stands for all other symbols of the name in the repository: callee is the class of the
    name, its smallest id (`name_members` has the members), and candidates says how many they are."""
    sure = sure_calls(spark, sf_dir)
    matched = sure.groupBy("caller", "name").agg(F.count("*").alias("m"))
    maybe = calls_by_name(spark, sf_dir).join(name_classes(spark, sf_dir), ["repo", "name"]).join(matched, ["caller", "name"], "left")
    left = F.col("members") - F.coalesce("m", F.lit(0))
    inferred = maybe.select("caller", F.col("representative").alias("callee"), F.lit("inferred").alias("resolution"), left.alias("candidates")).where("candidates > 0")
    return sure.select("caller", "callee", "resolution", F.lit(1).cast("bigint").alias("candidates")).unionByName(inferred)


@REGISTRY.query("name_members", _CALLS + "SELECT callee AS id, min(callee) OVER w AS class, count(*) OVER w AS members FROM nm WHERE repo IS NOT NULL WINDOW w AS (PARTITION BY repo, name)")
def name_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of its name that every symbol belongs to, and how many symbols that has."""
    rows = _named(spark, sf_dir).join(name_classes(spark, sf_dir), ["repo", "name"])
    return rows.select(F.col("callee").alias("id"), F.col("representative").alias("class"), "members")


_CODE = _CALLS + _IMPORTED + """, ce AS (
  SELECT DISTINCT src, repo || '#' || name AS dst FROM cl WHERE (repo, name) IN (SELECT (repo, name) FROM nm)
  UNION SELECT DISTINCT repo || '#' || name, dst FROM nm WHERE (repo, name) IN (SELECT (repo, name) FROM cl)
  UNION SELECT src, '#' || dst FROM im UNION SELECT '#' || dst, dst FROM im),
cn AS (SELECT src AS id FROM ce UNION SELECT dst FROM ce UNION SELECT file FROM s WHERE file IS NOT NULL)
"""


def code_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) and nodes (id) of the graph of files: a file leads to the names that it calls and the files that
    it imports, as nodes of their own with #, and these lead to the files that have them. Two steps are one from file to
    file, and there are as many edges as calls, symbols and imports."""
    calls, named, imported = calls_by_name(spark, sf_dir), _named(spark, sf_dir), import_edges(spark, sf_dir)
    node, target = F.concat("repo", F.lit("#"), "name"), F.concat(F.lit("#"), "dst")
    out = calls.join(named.select("repo", "name").distinct(), ["repo", "name"], "left_semi").select("src", node.alias("dst"))
    into = named.join(calls.select("repo", "name").distinct(), ["repo", "name"], "left_semi").select(node.alias("src"), "dst")
    e = out.unionByName(into).unionByName(imported.select("src", target.alias("dst"))).unionByName(imported.select(target.alias("src"), "dst")).distinct()
    cuts = Cuts(spark)
    e = cuts.cut(e)
    files = table(spark, sf_dir, "symbols").select(F.col("file").alias("id")).where("id is not null")
    return e, cuts.cut(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).unionByName(files).distinct())


def file_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, rank: PageRank of the files in the graph of code, rounded to 10 places."""
    edges, nodes = code_graph(spark, sf_dir)
    ranks = G.pagerank(edges, nodes, rounds=RANK_ROUNDS, tolerance=0.0)
    return ranks.where(~F.contains("id", F.lit("#"))).select(F.col("id").alias("file"), F.round("score", 10).alias("rank"))


#: Rounds of PageRank over code, always as many, so that ranks do not depend on when a run settles; two are one step from file to file.
RANK_ROUNDS = 12
_RANKED = _CODE + f""", dg AS (SELECT src, count(*) AS deg FROM ce GROUP BY src), ln AS (
  SELECT ce.src, ce.dst, 1e0 / deg AS w FROM ce JOIN dg ON ce.src = dg.src WHERE ce.src <> ce.dst UNION ALL SELECT id, id, 0e0 FROM cn UNION ALL SELECT id, NULL, 1e0 FROM cn WHERE id NOT IN (SELECT src FROM dg)),
nn AS (SELECT count(*)::DOUBLE AS n FROM cn),
pr(i, id, score) AS (
  SELECT 0, id, 1 / n FROM cn, nn
  UNION ALL
  SELECT i + 1, id, score FROM (
    SELECT i, dst AS id, 0.15e0 / n + 0.85e0 * (got + coalesce(sum(CASE WHEN dst IS NULL THEN got END) OVER (), 0e0) / n) AS score
    FROM (SELECT pr.i, ln.dst, sum(pr.score * ln.w) AS got FROM pr JOIN ln ON pr.id = ln.src WHERE pr.i < {RANK_ROUNDS} GROUP BY pr.i, ln.dst), nn) WHERE id IS NOT NULL),
fr AS (SELECT id AS file, round(score, 10) AS rank FROM pr WHERE i = {RANK_ROUNDS} AND NOT contains(id, '#'))
"""
_KINDS = "CASE lower(kind) WHEN 'class' THEN 0 WHEN 'type' THEN 1 WHEN 'function' THEN 2 WHEN 'method' THEN 3 ELSE 4 END"


@REGISTRY.query(
    "file_importance",
    _RANKED + f""", d AS (SELECT file, sum(files) AS uses FROM (SELECT DISTINCT file, name, files FROM uses) GROUP BY file),
b AS (SELECT file, arg_min(id, ({_KINDS}, -coalesce(byte_length, 0), id)) AS symbol FROM symbols GROUP BY file)
SELECT fr.file, rank, coalesce(uses, 0)::BIGINT AS uses, symbol FROM fr LEFT JOIN d USING (file) LEFT JOIN b USING (file) ORDER BY fr.rank DESC, fr.file LIMIT 100""",
)
def file_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 files of the highest PageRank, with how many times other files call one of their names and their first symbol by kind and size."""
    d = symbol_uses(spark, sf_dir).select("file", "name", "files").distinct().groupBy("file").agg(F.sum("files").alias("uses"))
    first = F.struct(F.expr(_KINDS).alias("k"), (-F.coalesce("byte_length", F.lit(0))).alias("s"), "id")
    b = table(spark, sf_dir, "symbols").groupBy("file").agg(F.min(first).alias("b"))
    top = file_ranks(spark, sf_dir).orderBy(F.desc("rank"), "file").limit(100)
    j = top.join(d, "file", "left").join(b, "file", "left")
    return j.select("file", "rank", F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses"), F.col("b.id").alias("symbol"))


@REGISTRY.query("code_pagerank", _RANKED + "SELECT file, rank FROM fr")
def code_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of every file by imports and calls."""
    return file_ranks(spark, sf_dir)


@REGISTRY.query(
    "code_cycles",
    _CODE + """, cf AS (SELECT a.src AS src, b.dst AS dst FROM ce a JOIN ce b ON a.dst = b.src WHERE NOT contains(a.src, '#') AND a.src <> b.dst GROUP BY ALL),
rr(a, b) AS (SELECT src, dst FROM cf UNION SELECT rr.a, cf.dst FROM rr JOIN cf ON rr.b = cf.src)
SELECT x.a AS file, least(min(x.b), x.a) AS component FROM rr x JOIN rr y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""",
)
def code_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that use each other in a circle, with the smallest file of the circle."""
    found = G.strong_components(code_graph(spark, sf_dir)[0]).where(~F.contains("id", F.lit("#")))
    named = found.groupBy("component").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return found.join(named, "component").select(F.col("id").alias("file"), F.col("first").alias("component"))


_ROOT = "SELECT min(file) FROM uses WHERE files > 0"


@REGISTRY.query("code_blast_radius", _CODE + f""", bb(id, level) AS (SELECT file, 0 FROM ({_ROOT}) q(file) WHERE file IS NOT NULL UNION SELECT ce.src, bb.level + 1 FROM bb JOIN ce ON ce.dst = bb.id WHERE bb.level < 8)
SELECT id AS file, (min(level) // 2)::INTEGER AS level FROM bb WHERE NOT contains(id, '#') GROUP BY id""")
def code_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of the first file that others use reaches backwards, up to four files on."""
    root = symbol_uses(spark, sf_dir).where("files > 0").agg(F.min("file").alias("id")).where("id is not null")
    found = G.bfs(G.invert(code_graph(spark, sf_dir)[0]), root, 8)
    return found.where(~F.contains("id", F.lit("#"))).select(F.col("id").alias("file"), F.expr("level div 2").cast("int").alias("level"))


_COOC = """
WITH m AS (SELECT DISTINCT branch, file FROM branch_deltas WHERE branch IS NOT NULL AND file IS NOT NULL),
k AS (SELECT branch FROM m GROUP BY branch HAVING count(*) BETWEEN 2 AND 20),
t AS (SELECT a.file AS src, b.file AS dst, count(*) AS weight FROM m a JOIN m b ON a.branch = b.branch AND a.file < b.file WHERE a.branch IN (SELECT branch FROM k) GROUP BY ALL)
"""


@REGISTRY.query("cochange_edges", _COOC + "SELECT * FROM t")
def cochange_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that change together on branches of 2 to 20 files."""
    return G.cooccurrence(table(spark, sf_dir, "branch_deltas"), "branch", "file", 20)


_SIGNALS = (
    _CALLS
    + _IMPORTED
    + _COOC.replace("WITH m", ", m", 1)
    + """, st AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS weight FROM im GROUP BY 1, 2),
nj AS (SELECT path, unnest(from_json(imports, '[{"names":["VARCHAR"]}]')).names AS names FROM fi), ni AS (SELECT DISTINCT path, unnest(names) AS name FROM nj),
nk AS (SELECT name FROM ni WHERE name IS NOT NULL GROUP BY name HAVING count(*) BETWEEN 2 AND 30),
bh AS (SELECT a.path AS src, b.path AS dst, count(*) AS weight FROM ni a JOIN ni b ON a.name = b.name AND a.path < b.path WHERE a.name IN (SELECT name FROM nk) GROUP BY ALL),
p AS (SELECT src, dst, 0.4e0 * weight / (SELECT max(weight) FROM st) AS w FROM st UNION ALL SELECT src, dst, 0.3e0 * weight / (SELECT max(weight) FROM bh) FROM bh
  UNION ALL SELECT src, dst, 0.3e0 * weight / (SELECT max(weight) FROM t) FROM t)
"""
)


def fused_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: import edges (0.4), files that import one name (0.3) and files that change together (0.3)."""
    from .code import imports

    structural = import_edges(spark, sf_dir).withColumn("weight", F.lit(1))
    names = imports(spark, sf_dir).select(F.col("importer").alias("file"), F.explode("names").alias("name"))
    return G.fuse_edges([(structural, 0.4), (G.cooccurrence(names, "name", "file", 30), 0.3), (cochange_edges(spark, sf_dir), 0.3)])


@REGISTRY.query("fused_edges", _SIGNALS + "SELECT src, dst, round(sum(w), 6) AS weight FROM p GROUP BY ALL")
def fused_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between files by imports, shared imported names and common changes, each by its largest weight, in one weight."""
    return fused_edges(spark, sf_dir)


@REGISTRY.query("module_map")
def module_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of files by label propagation over the fused edges, with cohesion, outer weight and anchor."""
    edges = Cuts(spark).cut(fused_edges(spark, sf_dir))
    return G.communities(G.label_propagation(edges), edges)


@REGISTRY.query("pruned_graph")
def pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused edges between files that are left when leaves fall off again and again."""
    edges = Cuts(spark).cut(fused_edges(spark, sf_dir))
    return G.prune_leaves(edges, edges.select(F.col("dst").alias("id")).limit(0))


#: what the ids of bases begin with that are no class of the repository
EXTERNAL = "external:"


@REGISTRY.query(
    "class_hierarchy",
    """WITH RECURSIVE c AS (SELECT DISTINCT id, parent, split_part(file, '/', 1) AS repo, name, signature FROM symbols WHERE lower(kind) IN ('class', 'type')),
sg AS (SELECT id, repo, regexp_extract(signature, '\\bextends\\s+([\\w.,\\s<>]+?)(\\s+(extends|implements)\\b|\\{|:|$)', 1) AS ex, regexp_extract(signature, '\\bimplements\\s+([\\w.,\\s<>]+?)(\\s+(extends|implements)\\b|\\{|:|$)', 1) AS im,
  regexp_extract(signature, '\\bclass\\s+\\w+\\s*\\(([^()]*)\\)', 1) AS br FROM c),
bl AS (SELECT id, repo, [trim(x) for x in string_split(regexp_replace(ex || ',' || im, '<[^<>]*>', '', 'g'), ',') if trim(x) <> ''] AS said, [trim(x) for x in string_split(br, ',') if regexp_matches(trim(x), '^[A-Z][\\w.]*$')] AS br FROM sg),
bs AS (SELECT id, repo, unnest(CASE WHEN len(said) > 0 THEN said ELSE br END) AS name FROM bl),
fst AS (SELECT repo, name, min(id) AS base FROM c GROUP BY ALL),
e AS (SELECT a.parent AS src, a.id AS dst FROM c a WHERE a.parent IN (SELECT id FROM c) AND a.id <> a.parent
  UNION SELECT coalesce(base, 'external:' || bs.repo || '::' || bs.name), bs.id FROM bs LEFT JOIN fst ON bs.repo = fst.repo AND bs.name = fst.name WHERE coalesce(base, '') <> bs.id),
r AS (SELECT src AS id FROM e WHERE NOT starts_with(src, 'external:') GROUP BY src HAVING count(DISTINCT dst) >= 2),
w(seed, id, level) AS (SELECT id, id, 0 FROM r UNION SELECT w.seed, e.dst, w.level + 1 FROM w JOIN e ON e.src = w.id WHERE w.level < 100),
u(seed, id, level) AS (SELECT id, id, 0 FROM r UNION SELECT u.seed, e.src, u.level - 1 FROM u JOIN e ON e.dst = u.id WHERE u.level > -100)
SELECT seed, id, min(level)::INTEGER AS level, starts_with(id, 'external:') AS external FROM w GROUP BY ALL
UNION ALL SELECT seed, id, max(level)::INTEGER, starts_with(id, 'external:') FROM u WHERE id <> seed GROUP BY ALL""",
)
def class_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All below (level > 0) and above (level < 0) each class that has two or more classes right below, external for
    bases that the repository has no class for. Classes hang on their parents and on the bases of their signatures."""
    c = table(spark, sf_dir, "symbols").where(F.lower("kind").isin("class", "type")).select("id", "parent", F.substring_index("file", "/", 1).alias("repo"), "name", "signature").distinct()
    parents = c.select(F.col("parent").alias("src"), F.col("id").alias("dst")).join(c.select(F.col("id").alias("src")), "src", "left_semi")
    first = c.groupBy("repo", "name").agg(F.min("id").alias("base"))
    based = c.select("repo", F.col("id").alias("dst"), F.explode(base_names(F.col("signature"))).alias("name")).join(first, ["repo", "name"], "left")
    outer = F.concat(F.lit(EXTERNAL), "repo", F.lit("::"), "name")
    e = G.simple_edges(parents.unionByName(based.select(F.coalesce("base", outer).alias("src"), "dst")))
    wide = e.groupBy("src").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("src").alias("id"))
    wide = wide.where(~F.col("id").startswith(EXTERNAL))
    up = G.bfs(G.invert(e), wide).where("level > 0").withColumn("level", -F.col("level"))
    return G.bfs(e, wide).unionByName(up).withColumn("external", F.col("id").startswith(EXTERNAL))


# What makes a symbol a way in, by its decorators, in this order.
GATEWAYS = (
    ("http", r"@(?:app|router|api|bp|blueprint)\.(?:get|post|put|delete|patch|route)\b|@route\b|@(?:get|post|put|delete|patch)mapping\b"),
    ("cli", r"@(?:cli|app)\.command|@click\.(?:command|group)|typer\..*command"),
    ("event", r"@on_event\b|@event_handler\b|@(?:app|router)\.websocket\b|@receiver\b|@signal\b"),
    ("task", r"@(?:celery|huey|dramatiq|rq)\.|@task\b|@shared_task\b|@periodic_task\b"),
)
_WAYS = (
    "s0 AS (SELECT DISTINCT id, name, file, kind, array_to_string(decorators, ' ') AS d FROM symbols), gw AS (SELECT id, CASE "
    + " ".join(f"WHEN regexp_matches(d, '(?i){p}') THEN '{k}'" for k, p in GATEWAYS)
    + " WHEN regexp_matches(file, '(^|/)(__main__|manage|wsgi|asgi|app|main|run|cli)[.]py$') AND lower(kind) IN ('function', 'class') THEN 'main' WHEN starts_with(name, 'test_') AND lower(kind) = 'function' THEN 'test' END AS gateway FROM s0)"
)


def _gateway() -> Column:
    """What kind of way in a symbol is, by decorator, file or name; null for others."""
    out = None
    for kind, pattern in GATEWAYS:
        test = F.array_join("decorators", " ").rlike("(?i)" + pattern)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    low = F.lower("kind")
    return out.when(F.col("file").rlike(r"(^|/)(__main__|manage|wsgi|asgi|app|main|run|cli)[.]py$") & low.isin("function", "class"), "main").when(F.col("name").startswith("test_") & (low == "function"), "test")


def gateways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, gateway of the symbols that are ways in, by decorator, file or name."""
    return table(spark, sf_dir, "symbols").select("id", _gateway().alias("gateway")).where("gateway is not null").distinct()


@REGISTRY.query("gateways", f"WITH {_WAYS} SELECT DISTINCT id, gateway FROM gw WHERE gateway IS NOT NULL")
def gateways_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that are ways in, and of which kind."""
    return gateways(spark, sf_dir)


def _class_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, dst: the classes of names that each symbol calls."""
    return calls_by_name(spark, sf_dir).join(name_classes(spark, sf_dir), ["repo", "name"]).select(F.col("caller").alias("id"), F.col("representative").alias("dst"))


def class_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: which classes of names call which, as their smallest ids."""
    members = name_members(spark, sf_dir).select("id", F.col("class").alias("src"))
    return _class_calls(spark, sf_dir).join(members, "id").select("src", "dst").distinct()


@REGISTRY.query(
    "signal_chains",
    _CALLS
    + f", {_WAYS}"
    + """, g AS (SELECT repo, name, min(callee) AS class FROM nm GROUP BY ALL), k AS (SELECT nm.callee AS id, g.class FROM nm JOIN g ON nm.repo = g.repo AND nm.name = g.name),
ke AS (SELECT DISTINCT cl.caller, g.class FROM cl JOIN g ON cl.repo = g.repo AND cl.name = g.name), ek AS (SELECT DISTINCT k.class AS src, ke.class AS dst FROM ke JOIN k ON ke.caller = k.id),
w(seed, class, level) AS (SELECT gw.id, ke.class, 1 FROM gw JOIN ke ON ke.caller = gw.id WHERE gateway IS NOT NULL UNION SELECT w.seed, ek.dst, w.level + 1 FROM w JOIN ek ON ek.src = w.class WHERE w.level < 5)
SELECT seed, class, min(level)::INTEGER AS level FROM w GROUP BY ALL""",
)
def signal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every way in calls, directly or through others, up to five calls on, as classes of names (`name_members`)."""
    cuts = Cuts(spark)
    rows = table(spark, sf_dir, "symbols").where("id is not null").select("id", "name", "file", "call_references", _gateway().isNotNull().alias("way"))
    # ids are long and met often, so they are numbered in their order; the smallest number of a name is its class
    rows = rows.withColumn("repo", F.substring_index("file", "/", 1)).drop("file").orderBy("id").withColumn("at", F.monotonically_increasing_id())
    rows = cuts.cut(rows.withColumn("r", F.min("at").over(Window.partitionBy("id"))).select("id", "at", "r", "repo", "name", "call_references", "way"))
    classes = cuts.cut(rows.where("name is not null and repo is not null").groupBy("repo", "name").agg(F.min("r").alias("class")))
    calls = rows.select("r", "repo", F.explode("call_references").alias("name")).where("name is not null").join(classes, ["repo", "name"])
    calls = cuts.cut(calls.select("r", F.col("class").alias("dst")).distinct())
    members = rows.select("r", "repo", "name").join(classes, ["repo", "name"]).select("r", F.col("class").alias("src")).distinct()
    between = calls.join(members, "r").select("src", "dst").distinct()
    # ways in are nodes below zero, as they are no class of their name
    first = cuts.cut(calls.join(rows.where("way").select("r").distinct(), "r").select((-1 - F.col("r")).alias("src"), "dst"))
    found = cuts.cut(G.bfs(first.unionByName(between), first.select(F.col("src").alias("id")), 5).where("level > 0"))
    names = rows.where("r = at")
    seeds, ends = names.select((-1 - F.col("r")).alias("seed"), F.col("id").alias("seed_id")), names.select("r", F.col("id").alias("class"))
    return found.join(ends, found["id"] == ends["r"]).select("seed", "class", "level").join(seeds, "seed").select(F.col("seed_id").alias("seed"), "class", "level")

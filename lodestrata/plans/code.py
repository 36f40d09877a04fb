"""Queries of filters, searches and resolution over the code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_match, is_test_file, whole_word_count
from ..operators import filters as L
from ..operators import resolve as R
from ..session import Cuts
from ..tables import table
from .graphs import _CALLS, calls_by_name, name_files, symbol_uses
from .registry import Registry

REGISTRY = Registry()
IMPORTS = "array<struct<specifier:string,names:array<string>>>"


def symbols(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    rows = table(spark, sf_dir, "symbols")
    return (rows.select(*cols) if cols else rows).distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_texts").select("path", "content").where("content is not null").distinct()


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """importer, language, specifier, names; cut-off JSON gives no imports."""
    rows = table(spark, sf_dir, "files").select("path", "language", "imports").distinct()
    whole = rows.where(F.col("imports").rlike(r"\]\s*$"))
    return whole.select(F.col("path").alias("importer"), "language", F.explode(F.from_json("imports", IMPORTS)).alias("i")).select("importer", "language", "i.specifier", "i.names")


@REGISTRY.query(
    "winnow",
    """SELECT id, cyclomatic FROM (SELECT DISTINCT id, kind, name, file, cyclomatic, call_references, summary, docstring FROM symbols)
WHERE kind IN ('function', 'method') AND coalesce(cyclomatic, 0) >= 2 AND regexp_matches(coalesce(name, ''), '^(parse|render|update)')
  AND contains(lower(concat_ws(' ', summary, docstring)), 'the') AND regexp_matches(coalesce(file, ''), '^.*/src/.*$') ORDER BY cyclomatic DESC, id LIMIT 50""",
)
def winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that meet a chain of conditions, the most complex first."""
    chain = [("kind", "set", "in", ["function", "method"]), ("cyclomatic", "number", "gte", 2), ("name", "text", "matches", "^(parse|render|update)"), (("summary", "docstring"), "prose", "contains", "the"), ("file", "path", "matches", "*/src/*")]
    rows = symbols(spark, sf_dir, "id", "kind", "name", "file", "cyclomatic", "call_references", "summary", "docstring")
    return L.winnow(rows, chain, [F.desc("cyclomatic"), F.asc("id")], 50).select("id", "cyclomatic")


@REGISTRY.query(
    "winnow_lists",
    """SELECT DISTINCT id FROM symbols WHERE len(list_filter(coalesce(decorators, []), lambda d: contains(lower(d), 'route') OR contains(lower(d), 'cached'))) > 0""",
)
def winnow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols one of whose decorators holds one of several words."""
    return symbols(spark, sf_dir, "id", "decorators").where(L.criterion("decorators", "list", "contains", ["Route", "cached"])).select("id").distinct()


_LINES = "t AS (SELECT DISTINCT path, content FROM file_texts WHERE content IS NOT NULL), l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM t)"


@REGISTRY.query("grep_context", f"WITH {_LINES}, c AS (SELECT *, lag(text) OVER w AS before, lead(text) OVER w AS after FROM l WINDOW w AS (PARTITION BY path ORDER BY line)) SELECT path, line::INTEGER AS line, text, coalesce(before, '') AS before, coalesce(after, '') AS after FROM c WHERE contains(lower(text), 'todo')")
def grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a word in any case, with the lines around."""
    found = L.grep(texts(spark, sf_dir), "path", "content", "TODO", context=1)
    return found.select("path", "line", "text", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@REGISTRY.query("grep_regex", f"WITH {_LINES} SELECT path, line::INTEGER AS line, text FROM l WHERE regexp_matches(text, '(?i)^\\s*(return|const)\\s+[a-z]+$')")
def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fit a pattern."""
    return L.grep(texts(spark, sf_dir), "path", "content", r"^\s*(return|const)\s+[a-z]+$", is_regex=True).select("path", "line", "text")


@REGISTRY.query("line_slice", f"WITH {_LINES} SELECT path, string_agg(text, chr(10) ORDER BY line) AS text FROM l WHERE line BETWEEN 2 AND 4 GROUP BY path")
def line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of every file that has them."""
    rows = texts(spark, sf_dir).where(F.size(F.split("content", "\n")) >= 2)
    return rows.select("path", L.line_range(rows, "content", 2, 4).alias("text"))


@REGISTRY.query(
    "symbol_slice",
    """WITH s AS (SELECT DISTINCT id, file, byte_offset, byte_length FROM symbols WHERE byte_offset IS NOT NULL AND byte_length > 0), t AS (SELECT DISTINCT path, content FROM file_texts WHERE content IS NOT NULL)
SELECT id, sha256(content[byte_offset + 1:byte_offset + byte_length]) AS digest FROM s JOIN t ON file = path WHERE strlen(content) = length(content) AND byte_offset + byte_length <= length(content)""",
)
def symbol_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the source bytes of every symbol that lies within what is kept of its file, for one-byte texts."""
    s = symbols(spark, sf_dir, "id", "file", "byte_offset", "byte_length").where("byte_offset is not null and byte_length > 0")
    j = s.join(texts(spark, sf_dir), F.col("file") == F.col("path")).where("octet_length(content) = char_length(content) and byte_offset + byte_length <= char_length(content)")
    return j.select("id", F.sha2(L.byte_slice(F.col("content"), F.col("byte_offset"), F.col("byte_length")), 256).alias("digest"))


@REGISTRY.query(
    "column_search",
    """WITH c AS (SELECT DISTINCT file AS model, lower(coalesce(name, '')) AS n, lower(coalesce(summary, '')) AS d, name AS col FROM symbols WHERE name IS NOT NULL),
p AS (SELECT model, col, (CASE WHEN n = 'parse config' THEN 30 WHEN contains(n, 'parse config') THEN 15 ELSE 0 END) + (CASE WHEN contains(d, 'parse config') THEN 8 ELSE 0 END)
 + 5 * (contains(n, 'parse')::INT + contains(n, 'config')::INT) + 2 * (contains(d, 'parse')::INT + contains(d, 'config')::INT) AS score FROM c)
SELECT model, col, max(score)::INTEGER AS score FROM p WHERE score > 0 GROUP BY ALL""",
)
def column_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within files as columns of models, scored by name and description."""
    rows = symbols(spark, sf_dir, "file", "name", "summary").where("name is not null")
    return L.column_search(rows, "name", "summary", "parse config").groupBy(F.col("file").alias("model"), F.col("name").alias("col")).agg(F.max("score").alias("score"))


@REGISTRY.query("glob_filter", "SELECT DISTINCT path FROM files WHERE regexp_matches(path, '^(.*/)?[^/]*_(config|schema)[.]py$') OR regexp_matches(path, '_(config|schema)[.]py$')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that fit one of two globs, at any depth."""
    p = F.col("path")
    return table(spark, sf_dir, "files").select("path").where(glob_match(p, "*_config.py") | glob_match(p, "*_schema.py")).distinct()


@REGISTRY.query("test_files", "SELECT DISTINCT path FROM files WHERE regexp_matches('/' || path, '/(tests?|__tests__)/') OR regexp_matches(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', ''), '^test_|_test$|[.]test$|[.]spec$|_spec$')")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of tests."""
    return table(spark, sf_dir, "files").select("path").where(is_test_file(F.col("path"))).distinct()


LAYERS = {"entry": ["cmd", "app", "services"], "core": ["internal", "lib", "src"], "checks": ["tests"]}
_LAYER = "CASE WHEN {0} IN ('cmd', 'app', 'services') THEN 'entry' WHEN {0} IN ('internal', 'lib', 'src') THEN 'core' WHEN {0} = 'tests' THEN 'checks' END"


@REGISTRY.query("layer_violations", _CALLS + f", x AS (SELECT DISTINCT src, cl.name, {_LAYER.format("split_part(src, '/', 2)")} AS src_layer, dst_layer, targets FROM cl JOIN (SELECT repo, name, {_LAYER.format("split_part(dst, '/', 2)")} AS dst_layer, count(DISTINCT dst) AS targets FROM nm GROUP BY ALL) n ON cl.repo = n.repo AND cl.name = n.name) SELECT * FROM x WHERE (src_layer = 'core' AND dst_layer IN ('entry', 'checks')) OR (src_layer = 'entry' AND dst_layer = 'checks')")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a file calls out of a layer which it must not use, with the number of files of that layer that have the name."""
    inner = lambda c: F.regexp_replace(c, r"^[^/]*/", "")
    prefixes = {k: [f"{p}/" for p in v] for k, v in LAYERS.items()}
    named = name_files(spark, sf_dir).groupBy("repo", "name", L.layer(inner("dst"), prefixes).alias("dst_layer")).agg(F.count("*").alias("targets"))
    calls = calls_by_name(spark, sf_dir).select("repo", "name", "src").distinct().join(named.where("dst_layer is not null"), ["repo", "name"])
    return L.layer_violations(calls.select("src", "name", "targets", "dst_layer"), inner("src"), None, prefixes, {"core": ["entry", "checks"], "entry": ["checks"]})


@REGISTRY.query(
    "stale_names",
    """WITH k AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL), r AS (SELECT DISTINCT unnest(call_references) AS ref FROM symbols),
s AS (SELECT ref FROM r WHERE ref IS NOT NULL AND ref NOT IN (SELECT name FROM k)),
d AS (SELECT ref, name, levenshtein(lower(ref), lower(name))::INTEGER AS d FROM s JOIN k ON abs(length(ref) - length(name)) <= 2), b AS (SELECT ref, min((d, name)) AS b FROM d WHERE d <= 2 GROUP BY ref)
SELECT ref, b[2] AS suggestion, b[1] AS edits FROM s LEFT JOIN b USING (ref)""",
)
def stale_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called names that no symbol has, with the nearest one that exists."""
    refs = table(spark, sf_dir, "symbols").select(F.explode("call_references").alias("ref"))
    return L.stale_references(refs, "ref", table(spark, sf_dir, "symbols").select("name"), "name", 2)


@REGISTRY.query(
    "duplicate_runs",
    f"""WITH {_LINES}, a AS (SELECT DISTINCT text FROM l WHERE path LIKE 'orbit-mono/%'), b AS (SELECT path, line FROM l WHERE path NOT LIKE 'orbit-mono/%' AND text IN (SELECT text FROM a)),
i AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM b)
SELECT path, min(line)::INTEGER AS first, max(line)::INTEGER AS last, count(*) AS length FROM i GROUP BY path, g HAVING count(*) >= 3""",
)
def duplicate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines and more outside one repository that it has somewhere, line by line."""
    rows = L.lines(texts(spark, sf_dir), "path", "content")
    mono = F.col("path").startswith("orbit-mono/")
    return L.duplicate_runs(rows.where(mono), rows.where(~mono), "path")


@REGISTRY.query(
    "file_tree",
    """WITH f AS (SELECT path, max(size_bytes) AS s FROM files WHERE path IS NOT NULL GROUP BY path), p AS (SELECT s, string_split(path, '/') AS l FROM f),
u AS (SELECT array_to_string(l[1:i], '/') AS dir, i::INTEGER AS depth, s FROM (SELECT l, s, unnest(range(1, len(l))) AS i FROM p))
SELECT dir, depth, count(*) AS files, sum(s)::BIGINT AS bytes FROM u GROUP BY ALL""",
)
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes below every directory."""
    rows = table(spark, sf_dir, "files").where("path is not null").groupBy("path").agg(F.max("size_bytes").alias("size"))
    return L.tree_counts(rows, "path", "size")


@REGISTRY.query(
    "repo_outline",
    "WITH f AS (SELECT DISTINCT path, lower(language) AS language FROM files) SELECT split_part(path, '/', 1) AS repo, split_part(path, '/', 2) AS top, coalesce(language, 'unknown') AS language, count(*) AS files FROM f GROUP BY ALL",
)
def repo_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per repository, top directory and language."""
    rows = table(spark, sf_dir, "files").select("path", F.lower("language").alias("language")).distinct()
    parts = F.split("path", "/")
    return rows.groupBy(parts[0].alias("repo"), F.get(parts, F.lit(1)).alias("top"), F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))


@REGISTRY.query("file_outline", "SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY line NULLS LAST, byte_offset NULLS LAST, id)::INTEGER AS place FROM (SELECT DISTINCT file, id, line, byte_offset FROM symbols)")
def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of every file in their order."""
    from ..operators.ranking import best_per_file

    rows = symbols(spark, sf_dir, "file", "id", "line", "byte_offset")
    return best_per_file(rows, "file", [F.asc_nulls_last("line"), F.asc_nulls_last("byte_offset"), F.asc("id")], 2**31 - 1).select("file", "id", "place")


@REGISTRY.query("word_counts", f"WITH t AS (SELECT DISTINCT path, content FROM file_texts WHERE content IS NOT NULL) SELECT path, len(regexp_extract_all(content, '\\breturn\\b'))::INTEGER AS n FROM t WHERE regexp_matches(content, '\\breturn\\b')")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a whole word stands in every file."""
    return texts(spark, sf_dir).select("path", whole_word_count(F.col("content"), "return").alias("n")).where("n > 0")


@REGISTRY.query("import_names", "WITH f AS (SELECT DISTINCT path, imports FROM files WHERE regexp_matches(imports, '\\]\\s*$')), i AS (SELECT path, unnest(from_json(imports, '[{\"specifier\":\"VARCHAR\",\"names\":[\"VARCHAR\"]}]')) AS i FROM f), n AS (SELECT path, unnest(list_append(i.names, regexp_extract(i.specifier, '[^/]*$'))) AS name FROM i) SELECT lower(name) AS name, count(DISTINCT path) AS files FROM n GROUP BY 1")
def import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of imported names and specifier stems: in how many files each stands."""
    rows = imports(spark, sf_dir)
    each = rows.select("importer", F.explode(F.concat("names", F.array(F.substring_index("specifier", "/", -1)))).alias("name"))
    return each.groupBy(F.lower("name").alias("name")).agg(F.count_distinct("importer").alias("files"))


_IMPORT_ROWS = "f AS (SELECT DISTINCT path, lower(language) AS language, imports FROM files WHERE regexp_matches(imports, '\\]\\s*$')), i AS (SELECT path, language, unnest(from_json(imports, '[{\"specifier\":\"VARCHAR\",\"names\":[\"VARCHAR\"]}]')) AS i FROM f)"


@REGISTRY.query(
    "resolve_imports",
    f"""WITH {_IMPORT_ROWS}, a AS (SELECT DISTINCT path AS importer, i.specifier AS specifier, regexp_replace(path, '/[^/]*$', '') || substring(i.specifier, 2) AS base FROM i WHERE i.specifier LIKE './%'),
e(o, ending) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(["", *R.ENDINGS, *("/index" + y for y in R.SCRIPT_ENDINGS), "/__init__.py"]))}),
h AS (SELECT importer, specifier, arg_min(base || ending, o) AS path FROM a, e WHERE base || ending IN (SELECT path FROM files) GROUP BY ALL)
SELECT a.importer, a.specifier, h.path FROM a LEFT JOIN h USING (importer, specifier)""",
)
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that each relative import means, if there is one."""
    rows = imports(spark, sf_dir).where(F.col("specifier").startswith("./"))
    return R.resolve_specifiers(rows, table(spark, sf_dir, "files").select("path"))


@REGISTRY.query(
    "import_stems",
    f"WITH {_IMPORT_ROWS}, n AS (SELECT DISTINCT regexp_extract(i.specifier, '[^/]*$') AS stem FROM i), p AS (SELECT DISTINCT path FROM files) SELECT stem, count(path) AS files FROM n JOIN p ON lower(stem) = lower(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')) GROUP BY stem",
)
def import_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of any directory bear the name that an import ends in."""
    names = imports(spark, sf_dir).select(F.substring_index("specifier", "/", -1).alias("stem")).distinct()
    return R.by_stem(names, "stem", table(spark, sf_dir, "files").select("path")).groupBy("stem").agg(F.count("*").alias("files"))


_POINTS = """
WITH d AS (SELECT DISTINCT branch, file, symbol_data FROM branch_deltas WHERE regexp_matches(symbol_data, '\\]\\s*$')),
x AS (SELECT branch, file, unnest(from_json(symbol_data, '[{"name":"VARCHAR","kind":"VARCHAR","line":"INTEGER"}]')) AS s FROM d),
p AS (SELECT DISTINCT concat_ws('|', branch, file, s.name, s.line) AS pid, file, s.line AS line, s.name AS name FROM x),
sp AS (SELECT DISTINCT id, file, name, line AS first, end_line FROM symbols WHERE file IS NOT NULL AND line IS NOT NULL),
a AS (SELECT pid, min((0, coalesce(end_line - first, 1099511627776), id)) AS b FROM p JOIN sp ON p.file = sp.file AND p.line >= first AND (p.line <= end_line OR end_line IS NULL) WHERE end_line IS NULL OR end_line >= first GROUP BY pid),
nm AS (SELECT pid, min((1, 0, id)) AS b FROM p JOIN sp ON p.file = sp.file AND p.name = sp.name GROUP BY pid),
lo AS (SELECT * FROM p WHERE file NOT IN (SELECT file FROM sp)),
sf AS (SELECT pid, max((length(sp.file), sp.file)) AS m FROM lo JOIN sp ON ends_with(sp.file, '/' || lo.file) GROUP BY pid),
su AS (SELECT sf.pid, min((2, 0, id)) AS b FROM sf JOIN lo USING (pid) JOIN sp ON sp.file = sf.m[2] AND sp.name = lo.name GROUP BY sf.pid),
r AS (SELECT pid, min(b) AS b FROM (SELECT * FROM a UNION ALL SELECT * FROM nm UNION ALL SELECT * FROM su) GROUP BY pid)
"""


@REGISTRY.query("point_resolution", _POINTS + "SELECT pid, b[3] AS symbol_id, CASE b[1] WHEN 0 THEN 'line' WHEN 1 THEN 'name' WHEN 2 THEN 'suffix' END AS how FROM p LEFT JOIN r USING (pid)")
def point_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol that each (file, line, name) of the branch deltas means."""
    d = table(spark, sf_dir, "branch_deltas").select("branch", "file", "symbol_data").where(F.col("symbol_data").rlike(r"\]\s*$")).distinct()
    x = d.select("branch", "file", F.explode(F.from_json("symbol_data", "array<struct<name:string,kind:string,line:int>>")).alias("s")).select("branch", "file", "s.name", "s.line")
    points = x.select(F.concat_ws("|", "branch", "file", "name", F.col("line").cast("string")).alias("pid"), "file", "line", "name").distinct()
    return R.resolve_points(points, symbols(spark, sf_dir, "id", "file", "name", "line", "end_line")).select("pid", "symbol_id", "how")


_EVIDENCE = "SELECT symbol_id, 0 AS o, 'runtime' AS kind, 1.0e0 AS c FROM runtime_calls UNION ALL SELECT symbol_id, 1, 'ranked', 0.85e0 FROM fused_results UNION ALL SELECT symbol_id, 2, 'embedded', 0.65e0 FROM symbol_embeddings"


@REGISTRY.query("surest_evidence", f"SELECT symbol_id, arg_min(kind, (-c, o)) AS kind, max(c) AS confidence FROM ({_EVIDENCE}) WHERE symbol_id IS NOT NULL GROUP BY symbol_id")
def surest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest evidence there is for each symbol."""
    t = lambda n: table(spark, sf_dir, n).select("symbol_id")
    return R.surest([(t("runtime_calls"), "runtime", 1.0), (t("fused_results"), "ranked", 0.85), (t("symbol_embeddings"), "embedded", 0.65)], "symbol_id")


@REGISTRY.query(
    "group_contracts",
    f"""WITH {_IMPORT_ROWS}, u AS (SELECT DISTINCT unnest(i.names) AS name, split_part(path, '/', 1) AS member FROM i),
x AS (SELECT name, min(split_part(file, '/', 1)) AS owner FROM symbols WHERE name IS NOT NULL GROUP BY name HAVING count(DISTINCT split_part(file, '/', 1)) = 1)
SELECT name, owner, count(*) AS importers FROM u JOIN x USING (name) WHERE member <> owner GROUP BY ALL HAVING count(*) >= 1""",
)
def group_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one repository has and others import."""
    repo = lambda c: F.substring_index(c, "/", 1).alias("member")
    exports = table(spark, sf_dir, "symbols").select("name", repo("file")).where("name is not null")
    used = imports(spark, sf_dir).select(F.explode("names").alias("name"), repo("importer"))
    return R.contracts(exports, used, 1)


@REGISTRY.query(
    "rename_collisions",
    _CALLS + """, t AS (SELECT DISTINCT id, file, 'parse_config' AS new_name FROM s WHERE name LIKE 'update%'), nb AS (SELECT DISTINCT nm.dst AS file, src AS other FROM cl JOIN nm ON cl.repo = nm.repo AND cl.name = nm.name),
o AS (SELECT id, new_name, file AS other FROM t UNION SELECT id, new_name, other FROM t JOIN nb USING (file)),
h AS (SELECT DISTINCT o.id FROM o JOIN s ON s.file = o.other AND s.name = o.new_name)
SELECT DISTINCT id, new_name, id IN (SELECT id FROM h) AS collision FROM t""",
)
def rename_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which symbols could not be renamed, as their file or one that calls into it has the name."""
    rows = symbols(spark, sf_dir, "id", "file", "name")
    targets = rows.where(F.col("name").startswith("update")).select("id", "file", F.lit("parse_config").alias("new_name"))
    # files that have the new name, the names they call, and the files that have these
    having = rows.join(targets.select(F.col("new_name").alias("name")).distinct(), "name", "left_semi").select(F.col("file").alias("src"), F.col("name").alias("new_name")).distinct()
    called = calls_by_name(spark, sf_dir).select("repo", "name", "src").distinct().join(having, "src").select("repo", "name", "new_name").distinct()
    near = name_files(spark, sf_dir).join(called, ["repo", "name"]).select(F.col("dst").alias("file"), "new_name").distinct()
    return R.name_taken(rows, targets, near)


@REGISTRY.query(
    "delete_safety",
    _CALLS + """, t AS (SELECT DISTINCT id, decorators FROM symbols), ep AS (SELECT id FROM t WHERE len(decorators) > 0),
ex AS (SELECT DISTINCT id FROM uses WHERE files > tests), inn AS (SELECT DISTINCT id FROM uses WHERE own > 0), te AS (SELECT DISTINCT id FROM uses WHERE files > 0)
SELECT DISTINCT id, CASE WHEN id IN (SELECT symbol_id FROM runtime_calls WHERE symbol_id IS NOT NULL) THEN 'runtime' WHEN id IN (SELECT id FROM ep) THEN 'entry_point' WHEN id IN (SELECT id FROM ex) THEN 'external' WHEN id IN (SELECT id FROM inn) THEN 'internal'
 WHEN id IN (SELECT id FROM te) THEN 'test_only' ELSE 'safe' END AS verdict FROM t""",
)
def delete_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against deleting each symbol: the first of runtime, entry point, outer, inner and test use."""
    rows = symbols(spark, sf_dir, "id", "decorators")
    uses = Cuts(spark).cut(symbol_uses(spark, sf_dir).where("files + own > 0"))
    steps = [(table(spark, sf_dir, "runtime_calls").select(F.col("symbol_id").alias("id")), "runtime"), (rows.where(F.size("decorators") > 0), "entry_point"), (uses.where("files > tests"), "external"), (uses.where("own > 0"), "internal"), (uses.where("files > 0"), "test_only")]
    return R.ladder(rows, "id", steps, "safe")


@REGISTRY.query(
    "root_packages",
    f"""WITH {_IMPORT_ROWS}, r AS (SELECT split_part(path, '/', 1) AS repo, language, i.specifier AS s FROM i)
SELECT repo, CASE WHEN starts_with(s, '.') THEN NULL WHEN language IN ('javascript', 'typescript', 'js', 'ts') THEN CASE WHEN starts_with(s, '@') THEN regexp_extract(s, '^(@[^/]+/[^/]+)', 1) ELSE split_part(s, '/', 1) END
 WHEN language = 'go' THEN array_to_string(string_split(s, '/')[1:3], '/') WHEN language = 'java' THEN array_to_string(string_split(s, '.')[1:2], '.') ELSE split_part(s, '.', 1) END AS package, count(*) AS n FROM r GROUP BY ALL""",
)
def root_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which packages each repository imports, by the rule of the language; null for its own files."""
    rows = imports(spark, sf_dir)
    package = R.root_package(F.col("specifier"), F.col("language"))
    return rows.groupBy(F.substring_index("importer", "/", 1).alias("repo"), package.alias("package")).agg(F.count("*").alias("n"))


@REGISTRY.query("file_freshness", "WITH f AS (SELECT path, max(mtime_ns) AS m, max(hash) AS h FROM files GROUP BY path), d AS (SELECT file, max(file_mtime_ns) AS dm, max(file_hash) AS dh FROM branch_deltas GROUP BY file) SELECT path, CASE WHEN dh IS NOT NULL AND dh IS DISTINCT FROM h AND coalesce(dm > m, false) THEN 'stale' WHEN dm > m + 1000000000 THEN 'edited' ELSE 'fresh' END AS freshness FROM f LEFT JOIN d ON path = file")
def file_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what is indexed of a file is behind what branches say of it."""
    f = table(spark, sf_dir, "files").groupBy("path").agg(F.max("mtime_ns").alias("m"), F.max("hash").alias("h"))
    d = table(spark, sf_dir, "branch_deltas").groupBy("file").agg(F.max("file_mtime_ns").alias("dm"), F.max("file_hash").alias("dh"))
    j = f.join(d, F.col("path") == F.col("file"), "left")
    stale = F.col("dh").isNotNull() & ~F.col("dh").eqNullSafe(F.col("h")) & (F.col("dm") > F.col("m"))
    return j.select("path", F.when(stale, "stale").when(F.col("dm") > F.col("m") + 1_000_000_000, "edited").otherwise("fresh").alias("freshness"))


@REGISTRY.query("reference_existence", "WITH k AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL), c AS (SELECT DISTINCT unnest(call_references) AS name FROM symbols) SELECT name, name IN (SELECT name FROM c WHERE name IS NOT NULL) AS referenced FROM k")
def reference_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any symbol calls a name."""
    rows = table(spark, sf_dir, "symbols")
    used = rows.select(F.explode("call_references").alias("name")).distinct().withColumn("referenced", F.lit(True))
    return rows.select("name").where("name is not null").distinct().join(used, "name", "left").withColumn("referenced", F.coalesce("referenced", F.lit(False)))

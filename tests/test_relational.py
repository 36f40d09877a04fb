import math

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import filters as L
from lodestrata.operators import metrics as M
from lodestrata.operators import resolve as R
from lodestrata.operators import similar as C
from lodestrata.operators import snapshots as S


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_criteria(spark):
    df = spark.createDataFrame([("a", 5, ["@Route('/x')"]), ("b", None, None), (None, 9, ["@cached"])], "n string, c int, d array<string>")
    keep = lambda *c: [r["c"] for r in df.where(L.criterion(*c)).collect()]
    assert keep("c", "number", "gte", 5) == [5, 9] and keep("c", "number", "lt", 1) == [None] and keep("d", "list", "contains", ["route"]) == [5] and keep("n", "set", "in", ["b", "x"]) == [None]
    for bad in (("c", "number", "like", 1), ("c", "nothing", "eq", 1), ("c", "number", "eq", None)):
        with pytest.raises(ValueError):
            L.criterion(*bad)


def test_grep(spark):
    df = spark.createDataFrame([("f", "one\nTwo x\nthree\ntwo"), ("g", None), ("h", "")], "k string, t string")
    got = rows(L.grep(df, "k", "t", "TWO", context=1))
    assert got == [("f", 2, "Two x", ["one"], ["three"]), ("f", 4, "two", ["three"], [])]


def test_stale_names_find_the_nearest(spark):
    names = ["parse_config", "render", "update_cache", "x"]
    known = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    refs = spark.createDataFrame([("parse_confg",), ("rendr",), ("render",), ("zzzzzz",), (None,), ("cupdate_cach",)], "ref string")
    got = {r["ref"]: (r["suggestion"], r["edits"]) for r in L.stale_references(refs, "ref", known, "name", 2).collect()}
    assert got == {"parse_confg": ("parse_config", 1), "rendr": ("render", 1), "zzzzzz": (None, None), "cupdate_cach": ("update_cache", 2)}


def test_duplicate_runs(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("x", 3, "r")], "k string, line int, text string")
    b = spark.createDataFrame([("y", i, t) for i, t in enumerate("zrqpzqp", 1)], "k string, line int, text string")
    assert rows(L.duplicate_runs(a, b, "k")) == [("y", 2, 4, 3)]


def test_columns_and_layers(spark):
    df = spark.createDataFrame([({"p": {"m": {"user_id": "the id of a user", "name": None}}},)], "md map<string,map<string,map<string,string>>>")
    flat = L.flatten_columns(df, "md")
    assert rows(L.column_search(flat, "column", "description", "user id"), "column", "score") == [("user_id", 14)]
    e = spark.createDataFrame([("lib/a", "app/b"), ("app/b", "lib/a"), ("x", "lib/a")], "src string, dst string")
    assert rows(L.layer_violations(e, F.col("src"), F.col("dst"), {"low": ["lib/"], "high": ["app/"]}, {"low": ["high"]}), "src", "dst") == [("lib/a", "app/b")]


def test_points(spark):
    spans = spark.createDataFrame([("a", "r/f.py", "f", 1, 100), ("b", "r/f.py", "g", 10, 600), ("c", "r/f.py", "h", 20, None), ("d", "r/sub/x.py", "k", 1, 2), ("d", "r/sub/x.py", "k", 1, 2)], "id string, file string, name string, line int, end_line int")
    points = spark.createDataFrame([(1, "r/f.py", 50, "z"), (2, "r/f.py", 500, None), (3, "r/f.py", 5000, "g"), (4, "r/f.py", None, "f"), (5, "sub/x.py", 99, "k"), (6, "none.py", 1, "f"), (7, "r/f.py", None, None)], "pid int, file string, line int, name string")
    got = {r["pid"]: (r["symbol_id"], r["how"]) for r in R.resolve_points(points, spans).collect()}
    assert got == {1: ("a", "line"), 2: ("b", "line"), 3: ("c", "line"), 4: ("a", "name"), 5: ("d", "suffix"), 6: (None, None), 7: (None, None)}


def test_specifiers(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b.ts", "a/util/index.js", "pkg/mod.py", "pkg/mod/__init__.py", "src/lib/x.ts", "a/c.service.ts")], "path string")
    imports = spark.createDataFrame([("a/m.ts", s) for s in ("./b", "./b.js", "./util", "pkg.mod", "@/lib/x", "./none", "./c.service", "../pkg/mod.py")] + [(None, "x")], "importer string, specifier string")
    got = {r["specifier"]: r["path"] for r in R.resolve_specifiers(imports, files, {"@/*": "src/*"}).collect()}
    assert got == {"./b": "a/b.ts", "./b.js": "a/b.ts", "./util": "a/util/index.js", "pkg.mod": "pkg/mod.py", "@/lib/x": "src/lib/x.ts", "./none": None, "./c.service": "a/c.service.ts", "../pkg/mod.py": "pkg/mod.py"}


def test_names_that_are_passed_on(spark):
    direct = spark.createDataFrame([("app", "index", "A"), ("app", "index", "B")], "importer string, path string, name string")
    passes = spark.createDataFrame([("index", "a", "A"), ("index", "all", None), ("all", "index", None), ("all", "b", "B")], "path string, target string, name string")
    assert rows(R.barrel_closure(direct, passes)) == sorted([("app", "index", "A"), ("app", "index", "B"), ("app", "a", "A"), ("app", "all", "A"), ("app", "all", "B"), ("app", "b", "B")], key=repr)


def test_namespaces_owners_and_tiers(spark):
    names = spark.createDataFrame([("App\\Http\\X",), ("App\\Y",), ("Z",)], "n string")
    prefixes = spark.createDataFrame([("App\\", "src/"), ("App\\Http\\", "web/")], "prefix string, dir string")
    assert rows(R.resolve_namespace(names, "n", prefixes)) == [("App\\Http\\X", "web/X.php"), ("App\\Y", "src/Y.php"), ("Z", None)]
    refs = spark.createDataFrame([(1, "a", "x"), (1, None, "y"), (1, "zz", "x"), (1, None, "none")], "query int, alias string, column string")
    models = spark.createDataFrame([(1, "b", 0), (1, "a", 1)], "query int, model string, at int")
    cols = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "model string, column string")
    assert {(r["alias"], r["column"]): r["model"] for r in R.column_owner(refs, models, cols).collect()} == {("a", "x"): "a", (None, "y"): "b", ("zz", "x"): "a", (None, "none"): None}
    t1, t2 = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "p")], [(1, "q"), (2, "r")]))
    assert rows(R.first_tier([t1, t2], ["id"])) == [(1, 0, "p"), (2, 1, "r")]
    assert rows(R.surest([(t2, "weak", 0.5), (t1, "sure", 1.0)], "id")) == [(1, "sure", 1.0), (2, "weak", 0.5)]
    sig = spark.createDataFrame([("class A(Base, *args, m.Mixin)",), ("class B<T> extends C<T> implements D, E {",), ("def f(X)",)], "s string")
    assert [r[0] for r in sig.select(R.base_names(F.col("s"))).collect()] == [["Base"], ["C", "D", "E"], []]


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("gone", "9")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("came", "9")], "k string, h string")
    diff = S.snapshot_diff(old, new, ["k"], "h")
    assert rows(diff) == [("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("came", "added"), ("gone", "removed")]
    assert rows(S.renames(diff, old, new, ["k"], "h"), "old_k", "new_k") == [("gone", "came")]
    delta = spark.createDataFrame([("a", "x", "Modify"), ("n", "y", "add"), ("b", None, "DELETE")], "k string, h string, action string")
    assert rows(S.overlay(old, delta, "k", "action")) == [("a", "x"), ("c", None), ("gone", "9"), ("n", "y")]
    state = spark.createDataFrame([("a", 1, 5.0, "t0"), (None, 1, 1.0, "t0")], "k string, n int, p double, f string")
    batch = spark.createDataFrame([("a", 2, None, "t1"), ("b", 3, 7.0, "t1"), (None, 1, 2.0, "t1")], "k string, n int, p double, f string")
    assert rows(S.keyed_upsert(state, batch, ["k"], ["n"], ["p"], ["f"])) == sorted([("a", 3, 5.0, "t0"), ("b", 3, 7.0, "t1"), (None, 2, 2.0, "t0")], key=repr)
    assert rows(S.subtree_merge(old, spark.createDataFrame([("c/x", "1")], "k string, h string"), "k", "c")) == sorted([("a", "1"), ("b", "2"), ("gone", "9"), ("c/x", "1")], key=repr)
    assert rows(S.carry_over(spark.createDataFrame([("a", None), ("b", "n")], "k string, h string"), old, ["k"], "h")) == [("a", "1"), ("b", "n")]
    assert rows(S.replace_key(old, spark.createDataFrame([("a", "7")], "k string, h string"), "k")) == sorted([("a", "7"), ("b", "2"), ("c", None), ("gone", "9")], key=repr)


def test_metrics(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 13)] + [("g", float("nan")), ("g", None), ("h", 1.0)], "g string, v double")
    n = F.col("n")
    got = {r["g"]: tuple(r)[1:] for r in M.percentile_by_index(df, ["g"], "v", {"a": F.expr("(n - 1) div 2"), "b": F.bround(0.95 * (n - 1), 0)}).collect()}
    assert got == {"g": (12, 6.0, 11.0), "h": (1, 1.0, 1.0)}
    code = spark.createDataFrame([("if a && b { for (x) { f([1]) } } else {}",), ("",), (None,)], "c string")
    assert [tuple(r) for r in code.select(M.cyclomatic(F.col("c")), M.bracket_depth(F.col("c"))).collect()] == [(5, 4), (0, 0), (0, None)]
    sig = spark.createDataFrame([("f(a, b: Map<K, V>, c=(1, 2))",), ("f(void)",), ("f()",), ("f",)], "s string")
    assert [r[0] for r in sig.select(M.param_count(F.col("s"))).collect()] == [3, 0, 0, 0]
    axes = spark.createDataFrame([(10.0, None), (2.0, 30.0)], "c double, d double")
    r = M.radar(axes, {"complexity": M.axis_score("complexity", F.col("c")), "dead": M.axis_score("dead", F.col("d"))}).collect()
    assert [(x["complexity"], x["dead"], x["composite"], x["grade"]) for x in r] == [(58.0, None, 58.0, "F"), (100.0, 0.0, 50.0, "F")]


def test_similar_records(spark):
    df = spark.createDataFrame([("a", ["x", "y", "z"], 10), ("b", ["x", "y", "z"], 9), ("c", ["x", "q"], 10), ("d", None, 1)], "id string, t array<string>, s int")
    pairs = C.similar_pairs(df, "id", "t", "s", 0.8)
    assert rows(pairs, "src", "dst") == [("a", "b")]
    assert rows(C.clusters(pairs), "id", "component", "links") == [("a", "a", 1), ("b", "a", 1)]


def test_similar_records_share_common_terms(spark):
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    recs = [(f"r{i:03}", rng.sample(words, rng.randint(1, 9)) + ["w0"], rng.choice([None, 0, 10, 11, 14, 40])) for i in range(130)]
    recs += [("none", [], 3), ("null", None, 3), ("same1", ["w0", "w1"], 10), ("same2", ["w1", "w0", "w1"], 10)]
    df = spark.createDataFrame(recs, "id string, t array<string>, s int")

    def score(x, y):
        a, b, s, z = {*(x[1] or [])}, {*(y[1] or [])}, x[2] or 0, y[2] or 0
        return round(0.7 * len(a & b) / len(a | b) + 0.3 * (min(s, z) / max(s, z) if s and z else 0), 6) if a & b else 0

    for least in (0.7, 0.45, 0.25):
        want = {(x[0], y[0]): score(x, y) for x in recs for y in recs if x[0] < y[0] and score(x, y) >= least}
        got = [(r["src"], r["dst"], r["similarity"]) for r in C.similar_pairs(df, "id", "t", "s", least).collect()]
        assert len(got) == len(want) and all(abs(want[a, b] - v) < 2e-6 for a, b, v in got)


def test_similar_records_by_buckets(spark):
    """Scores are rounded as SQL does, one pair at the threshold only by rounding; counts, nearest and clusters are those of the pairs."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    recs = [(f"r{i:03}", rng.sample(words[: rng.choice([6, 40])], rng.randint(1, 6)), rng.choice([None, 0, 100, 1600, 1601, 1599])) for i in range(250)]
    recs += [("r000", ["w0", "w1"], 5), (None, ["w0", "w1"], 5), ("half1", ["h0", "h1"], 45), ("half2", ["h0", "h1"], 1600)]
    recs += [("up1", [f"u{i}" for i in range(4)], 1000000), ("up2", [f"u{i}" for i in range(3)] + ["u9"], 931032), ("long1", [f"l{i}" for i in range(60)], 9), ("long2", [f"l{i}" for i in range(45)], 9)]
    df = spark.createDataFrame(recs, "id string, t array<string>, s long")

    def score(x, y):
        a, b, s, z = {*x[1]}, {*y[1]}, x[2] or 0, y[2] or 0
        return math.floor((0.7 * len(a & b) / len(a | b) + 0.3 * (min(s, z) / max(s, z) if s and z else 0)) * 1e6 + 0.5) / 1e6 if a & b else 0

    for least in (0.7, 0.699310):
        rows_ = [x for x in recs if x[0]]
        want = sorted((x[0], y[0], score(x, y)) for x in rows_ for y in rows_ if x[0] < y[0] and score(x, y) >= least)
        pairs = C.similar_pairs(df, "id", "t", "s", least)
        assert sorted(map(tuple, pairs.collect())) == want
        assert rows(C.similar_nearest(df, "id", "t", "s", least)) == rows(C.nearest(pairs))
        assert rows(C.similar_clusters(df, "id", "t", "s", least), "id", "component", "links") == rows(C.clusters(pairs), "id", "component", "links")
    assert ("half1", "half2", 0.708438) in want and ("up1", "up2", 0.69931) in want


def test_many_similar_records(spark):
    df = spark.range(4000).selectExpr("cast(id as string) as id", "array('a', 'b', concat('c', id % 2)) as t", "10 as s")
    assert C.similar_nearest(df, "id", "t", "s", 0.9).selectExpr("count(*)", "min(links)", "max(links)", "sum(similarity)").collect()[0] == (4000, 1999, 1999, 4000.0)
    assert C.similar_clusters(df, "id", "t", "s", 0.9).groupBy("component").count().orderBy("component").collect() == [("0", 2000), ("1", 2000)]

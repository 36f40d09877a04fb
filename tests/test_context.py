"""What surrounds records, and what projects say of themselves."""

import math

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.scores import mean_pool
from lodestrata.operators import context as C
from lodestrata.operators import similar
from lodestrata.sources import project as P


def test_contexts_add_what_is_missing(spark):
    s = spark.createDataFrame([("a", "x.py", ["k", "py"]), ("b", "y.py", None), ("c", None, ["k"])], "id string, file string, keywords array<string>")
    c = spark.createDataFrame([("x.py", ["py", "web", None]), ("x.py", ["api"]), ("z.py", ["no"]), (None, ["no"])], "file string, tags array<string>")
    assert {r["id"]: r["keywords"] for r in C.enrich(s, c).collect()} == {"a": ["k", "py", "api", "web"], "b": [], "c": ["k"]}


def test_mean_vectors_as_pooling_does_it(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.0]), ("c", None), ("c", []), (None, [1.0, 1.0])]
    got = {r["k"]: r["vector"] for r in C.mean_vectors(spark.createDataFrame(rows, "k string, v array<double>"), "k", "v").collect()}
    assert got.keys() == {"a", "b"} and all(math.isclose(x, math.sqrt(0.5)) for x in got["a"]) and got["b"] == [0.0, 0.0]
    one = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert all(math.isclose(x, math.sqrt(0.5)) for x in one.select(mean_pool(F.col("v"), F.col("m")).alias("p")).first()["p"])


def test_renames_change_whole_words(spark):
    t = spark.createDataFrame([("a", "go()\ngoing()\nx.go(go)\n$go"), ("b", None), ("c", "")], "path string, content string")
    got = [(r["line"], r["after"]) for r in C.rename_edits(t, "path", "content", "go", "run").orderBy("line").collect()]
    assert got == [(1, "run()"), (3, "x.run(run)")]
    with pytest.raises(ValueError):
        C.rename_edits(t, "path", "content", "go(", "x")


def test_bundles_by_strategy(spark):
    rows = [("g", "a", 60, 0.1), ("g", "b", 50, 0.9), ("g", "c", 40, 0.5), ("g", "d", 10, None)]
    df = spark.createDataFrame(rows, "g string, k string, size int, rank double")
    take = lambda strategy, budget=100: [r["k"] for r in C.bundle(df, "g", "k", "size", "rank", F.col("k") == "a", budget, strategy).orderBy("place").collect()]
    assert take("most_relevant") == ["b", "c", "d"] and take("core_first") == ["a", "c"] and take("compact", 3) == ["b", "c", "a"]
    with pytest.raises(ValueError):
        take("other")


def test_nearest_of_similar_records(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.8)], "src string, dst string, similarity double")
    assert {r["id"]: (r["links"], r["nearest"], r["similarity"]) for r in similar.nearest(pairs).collect()} == {"a": (2, "b", 0.9), "b": (2, "a", 0.9), "c": (2, "a", 0.9)}


def test_project_records(spark):
    texts = [
        ("r/Dockerfile", "FROM base:1\nCOPY src/run.py /app\nRUN x\nEXPOSE 80"), ("r/.env", "A=1\nexport B=secret\n# C=2"), ("r/package.json", '{"scripts": {"test": "node tools/check.js"}, "workspaces": ["packages/*", "!no"]}'), ("r/bad/package.json", "{"),
        ("r/Makefile", "build: a\n\tgo\n.PHONY: build\nX := 1\n"), ("r/compose.yaml", "services:\n  web:\n    image: 'nginx:1'\n"), ("r/.github/workflows/x.yml", "steps:\n  - uses: actions/checkout\n"), ("r/src/a.py", "FROM x"), ("r/none/Dockerfile", None),
    ]
    t = spark.createDataFrame(texts + texts[:1], "path string, content string")
    records = P.project_records(t)
    got = {(r["path"], r["key"], r["value"]) for r in records.collect()}
    assert got == {
        ("r/Dockerfile", "FROM", "base:1"), ("r/Dockerfile", "COPY", "src/run.py /app"), ("r/Dockerfile", "EXPOSE", "80"), ("r/.env", "variable", "A"), ("r/.env", "variable", "B"), ("r/package.json", "test", "node tools/check.js"), ("r/Makefile", "target", "build"),
        ("r/compose.yaml", "image", "nginx:1"), ("r/.github/workflows/x.yml", "uses", "actions/checkout"),
    }
    files = spark.createDataFrame([("r/src/run.py",), ("r/tools/check.js",), ("r/xcheck.js",), (None,)], "path string")
    assert {(r["path"], r["file"]) for r in P.file_references(records, files).collect()} == {("r/Dockerfile", "r/src/run.py"), ("r/package.json", "r/tools/check.js")}


def test_workspaces_and_members(spark):
    texts = [("r/package.json", '{"workspaces": {"packages": ["packages/*"]}}'), ("pnpm-workspace.yaml", "packages:\n  - 'apps/*'\n"), ("q/Cargo.toml", '[workspace]\nmembers = ["core", "./tools/x"]\n'), ("g/go.work", "go 1.2\nuse (\n\t./a\n\t./b\n)\n"), ("h/go.work", "use ./c\n"), ("z/package.json", "[]")]
    declared = P.workspaces(spark.createDataFrame(texts, "path string, content string"))
    assert {tuple(r) for r in declared.collect()} == {("r", "packages/*"), ("", "apps/*"), ("q", "core"), ("q", "tools/x"), ("g", "a"), ("g", "b"), ("h", "c")}
    files = ["r/packages/one/src/a.js", "r/other/a.js", "apps/web/b.ts", "q/tools/x/src/l.rs", "g/b/m.go", "top.js", None]
    got = {r["path"]: r["member"] for r in P.member_of(spark.createDataFrame([(f,) for f in files], "path string"), declared).collect()}
    assert got == {"r/packages/one/src/a.js": "r/packages/one", "apps/web/b.ts": "apps/web", "q/tools/x/src/l.rs": "q/tools/x", "g/b/m.go": "g/b"}


def test_notes_are_audited(spark):
    t = spark.createDataFrame([("r/NOTES.md", "Always run the tests.\nSee `src/a.py` and `src/gone.py`.\n"), ("q/NOTES.md", "  Always run the tests.\n"), ("r/x.md", "Always run the tests."), ("s/NOTES.md", None)], "path string, content string")
    files = spark.createDataFrame([("src/a.py",)], "path string")
    assert {r["path"]: (r["tokens"], r["repeated"], r["stale"]) for r in P.config_audit(t, files, ["NOTES.md"]).collect()} == {"r/NOTES.md": (14, 1, 1), "q/NOTES.md": (6, 1, 0)}

"""Calls between symbols whose names are not unique."""

from lodestrata.plans import graphs, ranking

SYMBOLS = "id string, file string, name string, kind string, signature string, parent string, call_references array<string>"


def write(spark, where, symbols, files=()):
    spark.createDataFrame(symbols, SYMBOLS).write.parquet(f"{where}/symbols.parquet")
    spark.createDataFrame(list(files), "path string, language string, imports string").write.parquet(f"{where}/files.parquet")
    return str(where)


SOURCES = [
    ("a.main", "r/a.py", "main", "function", None, None, ["go", "only"]),
    ("a.go", "r/a.py", "go", "function", None, None, []),
    ("b.go", "r/b.py", "go", "function", None, None, []),
    ("c.go", "r/c.py", "go", "function", None, None, []),
    ("c.only", "r/c.py", "only", "function", None, None, None),
    ("t.check", "r/tests/t.py", "check", "function", None, None, ["only", None, "missing"]),
    ("x.go", "other/a.py", "go", "function", None, None, ["only"]),
    ("n.one", None, "one", "function", None, None, ["go"]),
]
IMPORTS = [("r/a.py", "python", '[{"specifier": "./b", "names": ["go"]}]'), ("r/b.py", "python", "[]"), ("r/c.py", "python", None)]


def test_ambiguous_names_keep_every_match(spark, tmp_path):
    sf = write(spark, tmp_path / "sf", SOURCES + SOURCES[:1], IMPORTS)
    got = sorted(tuple(r) for r in graphs.call_graph(spark, sf).collect())
    assert got == [("a.main", "a.go", "inferred", 1), ("a.main", "a.go", "resolved", 1), ("a.main", "b.go", "imported", 1), ("a.main", "c.only", "inferred", 1), ("t.check", "c.only", "inferred", 1)]
    members = {r["id"]: (r["class"], r["members"]) for r in graphs.name_members(spark, sf).collect()}
    assert members["c.go"] == ("a.go", 3) and members["x.go"] == ("x.go", 1) and "n.one" not in members
    assert sorted(tuple(r) for r in ranking._centrality(spark, sf).collect()) == [("r/b.py", 1), ("r/c.py", 3)]


def test_uses_of_symbols_are_counted_by_name(spark, tmp_path):
    sf = write(spark, tmp_path / "sf", SOURCES, IMPORTS)
    uses = {r["id"]: (r["own"], r["files"], r["callers"], r["tests"], r["all_tests"]) for r in graphs.symbol_uses(spark, sf).collect()}
    assert uses["a.go"] == (1, 0, 0, 0, 0) and uses["b.go"] == (0, 1, 1, 0, 0) and uses["c.only"] == (0, 2, 2, 1, 1) and uses["x.go"] == (0, 0, 0, 0, 0)


def test_graph_of_files_has_no_pairs_of_files(spark, tmp_path):
    f = "function"
    many = [(f"s{i}", f"r/f{i}.py", "go", f, None, None, ["go"]) for i in range(40)]
    sf = write(spark, tmp_path / "sf", many + [("u", "r/u.py", "u", f, None, None, ["nothing"])])
    edges, nodes = graphs.code_graph(spark, sf)
    assert edges.count() == 80 and nodes.count() == 42
    ranks = {r["file"]: r["rank"] for r in graphs.file_ranks(spark, sf).collect()}
    assert len(ranks) == 41 and len({round(v, 8) for k, v in ranks.items() if k != "r/u.py"}) == 1 and ranks["r/u.py"] < ranks["r/f0.py"]
    assert {r["component"] for r in graphs.code_cycles(spark, sf).collect()} == {"r/f0.py"} and graphs.code_cycles(spark, sf).count() == 40
    assert {r["file"]: r["level"] for r in graphs.code_blast_radius(spark, sf).collect()} == {f"r/f{i}.py": min(i, 1) for i in range(40)}


def test_class_hierarchy_has_no_depth_and_walks_both_ways(spark, tmp_path):
    cls = lambda i, parent=None, signature=None: (f"r/a.py::{i}", "r/a.py", i, "class", signature, f"r/a.py::{parent}" if parent else None, [])
    chain = [cls(f"C{i}", f"C{i - 1}") for i in range(1, 9)]
    symbols = [cls("C0", None, "class C0(Root, Missing)"), cls("Root"), cls("D", "C0"), *chain, cls("E", None, "class E extends C8")]
    sf = write(spark, tmp_path / "sf", symbols)
    got = {(r["seed"], r["id"]): (r["level"], r["external"]) for r in graphs.class_hierarchy(spark, sf).collect()}
    want = {f"r/a.py::C{i}": (i, False) for i in range(9)} | {"r/a.py::D": (1, False), "r/a.py::E": (9, False), "r/a.py::Root": (-1, False), "external:r::Missing": (-1, True)}
    assert got == {("r/a.py::C0", k): v for k, v in want.items()}


def test_signal_chains_walk_over_numbers(spark, tmp_path, monkeypatch):
    from lodestrata.plans import graphs

    shape = "id string, file string, name string, kind string, decorators array<string>, call_references array<string>"
    rows = [
        ("z", "r/main.py", "start", "function", [], ["f", "start", "none"]), ("z", "r/main.py", "start", "function", [], ["f", "start", "none"]), ("f2", "r/a.py", "f", "function", None, ["g"]), ("f1", "r/b.py", "f", "method", None, None),
        ("g", "r/a.py", "g", "function", ["@task"], ["f", "f"]), ("other", "q/a.py", "f", "function", ["@task"], ["g"]), (None, "r/a.py", "g", "function", ["@task"], ["f"]), ("n", None, "f", "function", ["@task"], ["f"]),
    ]
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/symbols.parquet")
    kinds, bfs = [], graphs.G.bfs
    monkeypatch.setattr(graphs.G, "bfs", lambda edges, *rest: kinds.append(edges.schema["src"].dataType.simpleString()) or bfs(edges, *rest))
    got = sorted(map(tuple, graphs.signal_chains(spark, str(tmp_path)).select("seed", "class", "level").collect()))
    assert kinds == ["bigint"]  # ids as they are filled the disk
    assert got == [("g", "f1", 1), ("g", "g", 2), ("z", "f1", 1), ("z", "g", 2), ("z", "z", 1)]

"""Hierarchies against a plain walk on the driver."""

import random

import pytest

from lodestrata.operators.hierarchy import cycles, descendants, full_paths

SCHEMA = "id string, parent string, name string, k string, ptr int"


def brute(rows):
    parent = {}
    for i, p, *_ in rows:
        if i:
            parent[i] = min(x for x in (parent.get(i), p or None) if x) if (parent.get(i) or p) else None
    out = {}
    for i in parent:
        path, seen = [i], {i}
        while (p := parent[path[-1]]) in parent and p is not None:
            if p in seen:
                loop = path[path.index(p) :]
                out[i] = ("cycle", min(loop)) if i in loop else ("below", None)
                break
            path.append(p)
            seen.add(p)
        else:
            out[i] = ("tree", path[::-1])
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, p, (i or "").upper(), "x", 1) for i, p in rows], SCHEMA)
    want = brute(rows)
    found = {r["id"]: r["cycle_id"] for r in cycles(df, "id", "parent").collect()}
    assert found == {i: v[1] for i, v in want.items() if v[0] == "cycle"}
    paths = full_paths(df, "id", "parent", "name")
    got = {r["id"]: r for r in paths.collect()}
    assert set(got) == set(want)
    for i, (state, value) in want.items():
        assert got[i]["state"] == state, i
        if state == "tree":
            assert got[i]["path"] == [x.upper() for x in value] and got[i]["depth"] == len(value) - 1 and got[i]["root"] == value[0]
        else:
            assert got[i]["path"] is None and got[i]["depth"] is None and got[i]["root"] is None
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in descendants(paths).collect()}
    assert pairs == {(a, i, len(v[1]) - 1 - n) for i, v in want.items() if v[0] == "tree" for n, a in enumerate(v[1][:-1])}


def test_dirty_rows(spark):
    check(spark, [("a", None), ("b", "a"), ("b", "a"), ("c", "b"), ("d", ""), ("e", "gone"), ("f", "f"), ("g", "f"), (None, "a"), ("", "a"), ("h", "i"), ("i", "h"), ("j", "i"), ("é", "z"), ("z", "é")])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, seed):
    rng = random.Random(seed)
    n = 300
    rows = [(f"n{i}", None if rng.random() < 0.05 else f"n{rng.randrange(n) if rng.random() < 0.03 else max(0, i - rng.randint(1, 4))}") for i in range(n)]
    check(spark, rows)


def test_long_chain_and_long_cycle(spark):
    chain = [(f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(150)]
    loop = [(f"l{i:03}", f"l{(i + 1) % 90:03}") for i in range(90)] + [("hang", "l005")]
    check(spark, chain + loop)


def test_hot_parent(spark):
    check(spark, [("root", None), *((f"k{i}", "root") for i in range(400)), *((f"m{i}", f"k{i}") for i in range(0, 400, 7))])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cycles(df, "id", "parent").count() == 0
    assert full_paths(df, "id", "parent", "name").count() == 0

import random

from lodestrata.operators import graph as G


def make(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def closure(pairs, nodes):
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in out[n]:
                    out[n].add(b)
    return out


def test_components_and_cycles_against_closure(spark):
    rng = random.Random(7)
    nodes = list(range(30))
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(32)] + [(3, 3), (None, 2)]
    clean = [(a, b) for a, b in pairs if a is not None and a != b]
    reach = closure(clean, nodes)
    scc = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    want = {n: c for n, c in scc.items() if sum(x == c for x in scc.values()) > 1}
    assert {r["id"]: r["component"] for r in G.strong_components(make(spark, pairs)).collect()} == want
    both = closure(clean + [(b, a) for a, b in clean], nodes)
    ids = spark.createDataFrame([(n,) for n in nodes], "id int")
    assert {r["id"]: r["component"] for r in G.components(make(spark, pairs), ids).collect()} == {n: min(both[n]) for n in nodes}


def test_bfs_levels_and_paths(spark):
    e = make(spark, [(1, 2), (2, 3), (1, 4), (4, 3), (3, 1), (3, 5), (5, 6)])
    seed = spark.createDataFrame([(1,)], "id int")
    got = {r["id"]: (r["level"], r["path"]) for r in G.bfs(e, seed, 3, carry=True).collect()}
    assert got == {1: (0, [1]), 2: (1, [1, 2]), 4: (1, [1, 4]), 3: (2, [1, 2, 3]), 5: (3, [1, 2, 3, 5])}
    assert {r["id"] for r in G.bfs(e, seed).collect()} == {1, 2, 3, 4, 5, 6}


def test_pagerank_with_dangling_nodes(spark):
    pairs, nodes = [(1, 2), (1, 3), (2, 3), (1, 2)], [1, 2, 3, 4]
    rank = {n: 0.25 for n in nodes}
    edges = set(pairs)
    for _ in range(12):
        lost = rank[3] + rank[4]
        rank = {n: 0.15 / 4 + 0.85 * (sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == n) + lost / 4) for n in nodes}
    got = {r["id"]: r["score"] for r in G.pagerank(make(spark, pairs), spark.createDataFrame([(n,) for n in nodes], "id int"), rounds=12, tolerance=0.0).collect()}
    assert all(abs(got[n] - rank[n]) < 1e-9 for n in nodes) and abs(sum(got.values()) - 1) < 1e-9
    assert G.pagerank(make(spark, []), spark.createDataFrame([], "id int")).count() == 0


def test_communities(spark):
    pairs = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (10, 11, 1.0), (11, 12, 1.0), (10, 12, 1.0), (3, 10, 0.1)]
    e = spark.createDataFrame(pairs, "src int, dst int, weight double")
    labels = {r["id"]: r["label"] for r in G.label_propagation(e).collect()}
    assert labels[1] == labels[2] == labels[3] != labels[10] == labels[11] == labels[12]
    c = {r["label"]: r for r in G.communities(G.label_propagation(e), e).collect()}
    assert c[labels[1]]["size"] == 3 and c[labels[1]]["cohesion"] == 1.0 and c[labels[1]]["outer"] == 0.1


def test_edges_from_groups_and_signals(spark):
    m = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1), ("h", 2), ("h", 3), ("one", 9), (None, 1)] + [("big", i) for i in range(40)], "g string, i int")
    got = {(r["src"], r["dst"]): r["weight"] for r in G.cooccurrence(m, "g", "i", 30).collect()}
    assert got == {(1, 2): 2, (1, 3): 1, (2, 3): 1}
    fused = G.fuse_edges([(spark.createDataFrame([(1, 2, 4.0), (2, 1, 4.0), (2, 3, 4.0)], "src int, dst int, weight double"), 0.6), (spark.createDataFrame([(3, 2, 5.0)], "src int, dst int, weight double"), 0.4)])
    assert {(r["src"], r["dst"]): r["weight"] for r in fused.collect()} == {(1, 2): 0.6, (2, 3): 0.7}
    left = G.prune_leaves(make(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (1, 9)]), spark.createDataFrame([(9,)], "id int"))
    assert {tuple(r) for r in left.collect()} == {(1, 2), (2, 3), (1, 3), (1, 9)}


def test_labels_settle_where_all_would_move_at_once(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a in (1, 2, 3) for b in (11, 12, 13)], "src int, dst int, weight double")
    labels = {r["id"]: r["label"] for r in G.label_propagation(e).collect()}
    assert len(labels) == 6 and len(set(labels.values())) == 1

"""Graph operators over edges (src, dst) and nodes (id).

Loops run on the driver, one plan a round, over tables that are cut every few rounds. Joins are equi-joins
on node ids, aggregates are partial before they shuffle, and nothing but counts comes to the driver.
Self edges and repeated edges are dropped where that is the meaning, as said for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cuts


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges between two different nodes; null ends drop out."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def invert(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, once."""
    return edges.select("src", "dst").unionByName(invert(edges)).where("src <> dst").distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, out_degree, in_degree over distinct edges, 0 for nodes without any."""
    e = simple_edges(edges)
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counts = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").distinct().join(counts, "id", "left").select("id", zero("out_degree"), zero("in_degree"))


def coupling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, ca (used by), ce (uses), instability ce / (ca + ce), band."""
    d = degrees(edges, nodes).select("id", F.col("in_degree").alias("ca"), F.col("out_degree").alias("ce"))
    both = F.col("ca") + F.col("ce")
    inst = F.round(F.when(both > 0, F.col("ce") / both), 4)
    band = F.when(inst.isNull(), "isolated").when(inst > 0.7, "unstable").when(inst >= 0.3, "balanced").otherwise("stable")
    return d.select("id", "ca", "ce", inst.alias("instability"), band.alias("band"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None = None, carry: bool = False, cut_every: int = 3) -> DataFrame:
    """seed, id, level (, path): the nodes within ``depth`` steps of each of ``seeds`` (id), seeds at level 0.

    The first level holds; with ``carry`` path is the smallest of the shortest paths, as an array of ids. The
    frontier only meets nodes that its seed has not seen, so cycles end the loop.
    """
    cuts = Cuts(edges.sparkSession)
    e = cuts.cut(simple_edges(edges))
    start = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("level"), F.array("id").alias("path")).distinct()
    seen = frontier = cuts.cut(start if carry else start.drop("path"))
    level = 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(e, frontier["id"] == e["src"]).select("seed", F.col("dst").alias("id"), *([F.concat("path", F.array("dst")).alias("path")] if carry else []))
        step = step.groupBy("seed", "id").agg(F.lit(level).alias("level"), *([F.min("path").alias("path")] if carry else []))
        frontier = cuts.cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % cut_every == 0:
            seen = cuts.cut(seen)
    return seen


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, look_every: int = 4) -> DataFrame:
    """id, score. Repeated edges count once; the mass of nodes without edges out is spread evenly.

    Ends after ``rounds`` or once the ranks move by less than ``tolerance`` in all, which is looked at every
    few rounds. Edges with an end outside the nodes do not count. A round is one join and one sum: nodes keep themselves by an edge of weight 0, and what loose
    nodes hold goes to a null node, whose one number the driver reads. An empty table of nodes gives no rows.
    """
    cuts = Cuts(edges.sparkSession)
    ids = cuts.cut(nodes.select("id").where("id is not null").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    inside = simple_edges(edges).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = cuts.cut(inside.select("src", "dst"))
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    kind = ids.schema["id"].dataType
    stay = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))
    loose = ids.select(F.col("id").alias("src")).join(out, "src", "left_anti").select("src", F.lit(None).cast(kind).alias("dst"), F.lit(1.0).alias("w"))
    links = cuts.cut(e.join(out, "src").select("src", "dst", (1.0 / F.col("deg")).alias("w")).unionByName(stay).unionByName(loose))
    ranks, before = ids.withColumn("score", F.lit(1.0 / n)), None
    for i in range(1, rounds + 1):
        got = cuts.cut(links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("got")))
        lost = got.where("dst is null").agg(F.sum("got")).first()[0] or 0.0
        fresh = got.where("dst is not null").select(F.col("dst").alias("id"), ((1 - damping) / n + damping * (F.col("got") + lost / n)).alias("score"))
        still = tolerance and i % look_every == 0 and fresh.join(ranks.withColumnRenamed("score", "was"), "id").agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] < tolerance
        if before is not None:
            cuts.drop(before)
        ranks, before = fresh, got
        if still:
            break
    return ranks.select("id", "score")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, component: the smallest id that is connected, by alternating large and small stars.

    Every node hangs itself and its neighbours on the smallest of them; stars merge in a number of rounds
    that grows with the logarithm of the graph, and no component is gathered anywhere.
    """
    cuts = Cuts(edges.sparkSession)
    now = cuts.cut(edges.select("src", "dst").where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    while True:
        both = now.unionByName(invert(now))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        large = cuts.cut(large)
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src")
        links = small.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.select("src", F.col("m").alias("dst")))
        new = cuts.cut(links.where("src <> dst").distinct())
        same = new.count() == now.count() and new.join(now, ["src", "dst"], "left_anti").isEmpty()
        cuts.drop(large, now)
        now = new
        if same:
            break
    found = now.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    roots = now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    out = found.unionByName(roots)
    if nodes is None:
        return out
    return nodes.select("id").distinct().join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component of nodes in strongly connected components of two or more; component is the smallest id.

    Nodes without edges in or out are trimmed away. Then every node takes the smallest id that reaches it,
    and what reaches back to that id within its colour is its component; the rest goes into the next round.
    """
    cuts = Cuts(edges.sparkSession)
    left, found = cuts.cut(simple_edges(edges)), []
    while not left.isEmpty():
        while True:  # trim
            keep = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            keep = cuts.cut(keep.select("src", "dst"))
            if keep.count() == left.count():
                break
            left = keep
        if left.isEmpty():
            break
        ids = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()
        colour = cuts.cut(ids.withColumn("c", F.col("id")))
        while True:  # the smallest id forward along the edges
            sent = left.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c2"))
            new = cuts.cut(colour.join(sent, "id", "left").select("id", F.least("c", "c2").alias("c"), (F.col("c2") < F.col("c")).alias("moved")))
            done = new.where("moved").isEmpty()
            colour = new.select("id", "c")
            if done:
                break
        inner = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        inner = cuts.cut(inner.select("src", "dst", F.col("cs").alias("c")))
        member = cuts.cut(colour.where("id = c"))
        frontier = member
        while not frontier.isEmpty():  # back along the edges of one colour
            back = inner.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "c").distinct()
            frontier = cuts.cut(back.join(member.select("id"), "id", "left_anti"))
            member = member.unionByName(frontier)
        member = cuts.cut(member)
        found.append(member)
        left = left.join(member.select(F.col("id").alias("src")), "src", "left_anti").join(member.select(F.col("id").alias("dst")), "dst", "left_anti")
        left = cuts.cut(left.select("src", "dst"))
    if not found:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    size = every.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    return every.join(size, "c", "left_semi").select("id", F.col("c").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, label over weighted undirected edges (src, dst, weight): nodes take the heaviest label around them, their own
    if it is among the heaviest, else of several the smallest; until none moves, for ``rounds`` at most.

    Of the nodes that would move a half, by a hash of node and round, does; neighbours that always moved at once might
    change labels for ever.
    """
    cuts = Cuts(edges.sparkSession)
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst")
    links = cuts.cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = cuts.cut(links.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct())
    for i in range(rounds):
        votes = links.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        own = votes.join(labels.withColumnRenamed("label", "own"), "id")
        best = own.groupBy("id", "own").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b"), F.max(F.when(F.col("label") == F.col("own"), F.col("w"))).alias("kept"))
        to = best.where(F.coalesce(F.col("kept"), F.lit(-1.0)) < -F.col("b.w")).select("id", F.col("b.label").alias("to"))
        now = F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)) == 0, F.col("to"))
        new = cuts.cut(labels.join(to, "id", "left").select("id", F.coalesce(now, "label").alias("label"), F.col("to").isNotNull().alias("moves")))
        still = new.where("moves").isEmpty()
        cuts.drop(labels)
        labels = new.select("id", "label")
        labels._cut_path = new._cut_path
        if still:
            break
    return labels.select("id", "label")


def communities(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """label, size, cohesion (inner weight by possible pairs), outer (weight to other labels), anchor (heaviest node)."""
    own = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    e = edges.select("src", "dst", "weight").join(own("src"), "src").join(own("dst"), "dst")
    inner = F.col("src_label") == F.col("dst_label")
    ends = e.select(F.col("src_label").alias("label"), "weight", inner.alias("inner"), F.col("src").alias("id")).unionByName(e.select(F.col("dst_label").alias("label"), "weight", inner.alias("inner"), F.col("dst").alias("id")))
    per = ends.groupBy("label").agg((F.sum(F.when(F.col("inner"), F.col("weight"))) / 2).alias("inside"), F.sum(F.when(~F.col("inner"), F.col("weight"))).alias("outer"))
    heavy = ends.where("inner").groupBy("label", "id").agg(F.round(F.sum("weight"), 9).alias("w")).groupBy("label").agg(F.min(F.struct((-F.col("w")).alias("w"), "id")).alias("a"))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    joined = size.join(per, "label", "left").join(heavy, "label", "left")
    return joined.select("label", "size", F.round(F.when(pairs > 0, F.coalesce("inside", F.lit(0.0)) / pairs).otherwise(0.0), 6).alias("cohesion"), F.round(F.coalesce("outer", F.lit(0.0)), 6).alias("outer"), F.col("a.id").alias("anchor"))


def cooccurrence(members: DataFrame, group: str, item: str, most: int = 30, least: int = 2) -> DataFrame:
    """src, dst, weight: in how many groups two items stand together.

    Groups of over ``most`` items say nothing about pairs and are left out by definition, which also bounds
    the pairs of a group.
    """
    rows = members.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct()
    fits = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select(group)
    kept = rows.join(fits, group, "left_semi")
    other = kept.select(group, F.col(item).alias("dst"))
    return kept.select(group, F.col(item).alias("src")).join(other, group).where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def fuse_edges(signals: list[tuple[DataFrame, float]]) -> DataFrame:
    """src, dst, weight: undirected edges of several signals, each by its own largest weight, times its part."""
    parts = []
    for edges, part in signals:
        e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        most = e.agg(F.max("weight").alias("m"))
        parts.append(e.crossJoin(F.broadcast(most)).select("src", "dst", (part * F.col("weight") / F.col("m")).alias("weight")))  # one row
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src", "dst").agg(F.round(F.sum("weight"), 6).alias("weight"))


def prune_leaves(edges: DataFrame, keep: DataFrame, rounds: int = 50) -> DataFrame:
    """The undirected edges left after nodes of one neighbour, but for those in ``keep`` (id), fell off again and again."""
    cuts = Cuts(edges.sparkSession)
    left = cuts.cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
    for _ in range(rounds):
        ends = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id")))
        leaves = ends.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").join(keep.select("id"), "id", "left_anti").select("id")
        new = cuts.cut(left.join(leaves.withColumnRenamed("id", "src"), "src", "left_anti").join(leaves.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
        same = new.count() == left.count()
        left = new
        if same:
            break
    return left


def rank_in_order(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their place from 1."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # at most n rows

"""Parent-child rows to full hierarchies, with cycles reported.

The rows form a pointer graph: every node has at most one parent. A deterministic hash makes about
one node in ``splitter_rate`` a splitter. Every node walks, in doubling strides, to its next splitter
or to its root; as no splitter lies between, these walks are short whatever the depth of the tree.
The splitters alone then form a reduced pointer graph, which doubling solves without carrying paths.
Cycles without any splitter show while walking, as the walk meets its own start; cycles with splitters
show in the reduced graph, where only they are left over.

Every join is an equi-join on a 16-byte digest of the id, unique on the looked-up side, so a parent
with a third of all children is split by the adaptive skew join. No path, tree or cycle is gathered
in one task: paths are arrays in the rows they belong to and descendants come out as pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Cuts
from ..tables import blank_to_null


def _key(col: Column) -> Column:
    return F.unhex(F.md5(col))


@dataclass
class Links:
    """A solved pointer graph.

    nodes: k, id, label of all nodes. walks: k, ptr, seg (keys from the parent up to ptr), lab (their
    labels, where asked for), state: 'splitter', 'root', 'cycle' or 'below'. reduced: k, ptr of the
    splitters that reach a root. cycles: id, cycle_id.
    """

    nodes: DataFrame
    walks: DataFrame
    reduced: DataFrame
    cycles: DataFrame
    cuts: Cuts


def solve_links(
    df: DataFrame, id_col: str, parent_col: str, label_col: str | None = None, splitter_rate: int = 4
) -> Links:
    """Solve the pointer graph of ``df``.

    Null and empty ids are no nodes. A null, empty or unknown parent makes a root. Rows with one id are
    one node; where they differ, the smallest parent and label by code points hold. Columns besides the
    named ones are not read, so clashing names do no harm; an empty table gives empty results.
    """
    spark = df.sparkSession
    cuts = Cuts(spark)
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent"), label.alias("label"))
    nodes = cuts.cut(
        rows.where("id <> ''")
        .groupBy("id")
        .agg(F.min(blank_to_null(F.col("parent"))).alias("parent"), F.min("label").alias("label"))
        .select(_key(F.col("id")).alias("k"), _key(F.col("parent")).alias("p"), "id", "label")
    )
    splitter = lambda c: F.pmod(F.xxhash64(c), F.lit(splitter_rate)) == 0
    parents = nodes.select(F.col("k").alias("p"), F.col("label").alias("plabel"))
    first = nodes.where("p is not null").select("k", "p").join(parents, "p")
    walk = cuts.cut(
        first.select(
            "k",
            F.col("p").alias("ptr"),
            F.array("p").alias("seg"),
            (F.array(F.coalesce("plabel", F.lit(""))) if label_col else F.lit(None).cast("array<string>")).alias("lab"),
            F.when(F.col("k") == F.col("p"), "cycle").when(splitter(F.col("p")), "splitter").alias("state"),
        )
    )
    done, active = [walk.where("state is not null")], walk.where("state is null")
    everything = walk
    rounds, known_nodes = 0, nodes.count()
    longest = splitter_rate * (math.log(max(2, known_nodes)) + 10)
    while not active.isEmpty():
        known = everything.select(F.col("k").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("seg").alias("seg2"), F.col("lab").alias("lab2"), F.col("state").alias("state2"))
        joined = active.drop("state").join(known, "ptr", "left")
        seg = F.when(F.col("ptr2").isNull(), F.col("seg")).otherwise(F.concat("seg", "seg2"))
        stepped = joined.select(
            "k",
            F.coalesce("ptr2", "ptr").alias("ptr"),
            seg.alias("seg"),
            (F.when(F.col("ptr2").isNull(), F.col("lab")).otherwise(F.concat("lab", "lab2")) if label_col else F.col("lab")).alias("lab"),
            F.when(F.col("ptr2").isNull(), "root").when(F.col("state2").isin("splitter", "root"), F.col("state2")).alias("ended"),
        ).withColumn(
            "state",
            F.when(F.col("ended").isNotNull(), F.col("ended"))
            .when(F.array_contains("seg", F.col("k")), "cycle")
            .when(F.size(F.array_distinct("seg")) < F.size("seg"), "below"),
        ).drop("ended")
        new = cuts.cut(stepped)
        done.append(new.where("state is not null"))
        active = new.where("state is null")
        everything = _union([*done, active])
        rounds += 1
        if 2**rounds > 64 * longest + known_nodes:
            raise RuntimeError("the walk does not end")
    walks = everything

    splitters = walks.where(splitter(F.col("k")))
    ended = F.when(F.col("state") == "root", "root").when(F.col("state") != "splitter", "loop")
    small = cuts.cut(splitters.select("k", "ptr", ended.alias("ended")))
    reduced, cyclic = _solve_reduced(small, cuts)

    loops = _loops(walks, nodes, cyclic, cuts)
    return Links(nodes, walks, reduced.where("ended = 'root'").drop("ended"), loops, cuts)


def _solve_reduced(small: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame | None]:
    """Double the pointers of the splitters. Gives those that come to an end, and those that lie on a cycle.

    The pointers of what never ends have a smaller and smaller image, until just the cycles are left:
    when doubling leaves the size of the image as it was, the map is one-to-one on it, so it is the cycles.
    """
    done, active, image = [small.where("ended is not null")], small.where("ended is null"), -1
    everything, now = small, active.count()
    while now:
        known = everything.select(F.col("k").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("ended").alias("ended2"))
        new = cuts.cut(
            active.select("k", "ptr")
            .join(known, "ptr", "left")
            .select("k", F.coalesce("ptr2", "ptr").alias("ptr"), F.when(F.col("ptr2").isNull(), "root").otherwise(F.col("ended2")).alias("ended"))
        )
        done.append(new.where("ended is not null"))
        active = new.where("ended is null")
        everything = _union([*done, active])
        now = active.select("ptr").distinct().count()
        if now and now == image:
            return _union(done), active.select(F.col("ptr").alias("k")).distinct()
        image = now
    return _union(done), None


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _loops(walks: DataFrame, nodes: DataFrame, cyclic: DataFrame | None, cuts: Cuts) -> DataFrame:
    """id, cycle_id of all nodes on cycles; cycle_id is the smallest id by code points."""
    names = nodes.select("k", "id")
    plain = (
        walks.where("state = 'cycle'")
        .select("k", F.array_min(F.slice("seg", 1, F.array_position("seg", F.col("k")).cast("int"))).alias("loop"))
        .join(names, "k")
    )
    found = plain.join(plain.groupBy("loop").agg(F.min("id").alias("cycle_id")), "loop").select("id", "cycle_id")
    if cyclic is None:
        return found
    hops = walks.join(cyclic, "k", "left_semi").select("k", "ptr", "seg")
    members = cuts.cut(hops.select(F.col("k").alias("s"), "ptr", F.explode("seg").alias("k")).join(names, "k"))
    low = cuts.cut(members.groupBy("s", "ptr").agg(F.min("id").alias("low")))
    while True:  # the smallest id of 1, 2, 4, ... hops on, until a round changes none
        ahead = low.select(F.col("s").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        new = cuts.cut(low.join(ahead, "ptr").select("s", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        cuts.drop(low)
        low = new
        if low.where("moved").isEmpty():
            break
    return found.unionByName(members.join(low.select("s", "low"), "s").select("id", F.col("low").alias("cycle_id")))


def cycles(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """id, cycle_id of the nodes that lie on a cycle of parents, their own parents included."""
    return solve_links(df, id_col, parent_col).cycles


def full_paths(df: DataFrame, id_col: str, parent_col: str, label_col: str) -> DataFrame:
    """id, state, depth, root, ancestors (ids, from the root down), path (labels, from the root down and
    its own at the end) of every node.

    state is 'tree', 'cycle' for a node on a cycle and 'below' for one that hangs below a cycle; the
    latter two have null depth, root, ancestors and path.
    """
    links = solve_links(df, id_col, parent_col, label_col)
    cuts, walks = links.cuts, links.walks
    # exact paths of the splitters, by doubling over the reduced graph
    over = links.reduced.select("k")
    up = walks.join(over, "k", "left_semi").select("k", "ptr", "seg", "lab", (F.col("state") == "root").alias("over"))
    start = cuts.cut(up)
    done, active, everything = [start.where("over")], start.where("not over"), start
    while not active.isEmpty():
        known = everything.select(F.col("k").alias("ptr"), *(F.col(c).alias(c + "2") for c in ("ptr", "seg", "lab", "over")))
        more = F.col("ptr2").isNotNull()
        new = cuts.cut(
            active.drop("over")
            .join(known, "ptr", "left")
            .select(
                "k",
                F.coalesce("ptr2", "ptr").alias("ptr"),
                F.when(more, F.concat("seg", "seg2")).otherwise(F.col("seg")).alias("seg"),
                F.when(more, F.concat("lab", "lab2")).otherwise(F.col("lab")).alias("lab"),
                F.coalesce("over2", F.lit(True)).alias("over"),
            )
        )
        done.append(new.where("over"))
        active = new.where("not over")
        everything = _union([*done, active])
    tops = everything.select(F.col("k").alias("ptr"), F.col("seg").alias("seg2"), F.col("lab").alias("lab2"))
    # a walk that ends at a splitter goes on with the path of that splitter, unless this is a root itself
    onward = walks.where("state = 'splitter'").join(tops, "ptr").select("k", F.concat("seg", "seg2").alias("seg"), F.concat("lab", "lab2").alias("lab"))
    rooted = walks.where("state = 'splitter'").join(walks.select(F.col("k").alias("ptr")), "ptr", "left_anti").select("k", "seg", "lab")
    above = walks.where("state = 'root'").select("k", "seg", "lab").unionByName(onward).unionByName(rooted)
    looped = links.cycles.select("id", F.lit(True).alias("looped"))
    has_parent = walks.select("k", F.lit(True).alias("linked"))
    joined = links.nodes.select("k", "id", "label").join(above, "k", "left").join(has_parent, "k", "left").join(looped, "id", "left")
    state = F.when(F.col("looped"), "cycle").when(F.col("seg").isNotNull() | F.col("linked").isNull(), "tree").otherwise("below")
    keys = cuts.cut(joined.select("k", "id", "label", "seg", "lab", state.alias("state")))
    tree = F.col("state") == "tree"
    seg, lab = F.coalesce("seg", F.array().cast("array<binary>")), F.coalesce("lab", F.array().cast("array<string>"))
    root = keys.select(F.col("k").alias("rk"), F.col("id").alias("root"))
    return (
        keys.withColumn("rk", F.when(tree, F.when(F.size(seg) > 0, F.element_at(seg, -1)).otherwise(F.col("k"))))
        .join(root, "rk", "left")
        .select(
            "k",
            "id",
            "state",
            F.when(tree, F.size(seg)).alias("depth"),
            F.when(tree, F.col("root")).alias("root"),
            F.when(tree, F.reverse(seg)).alias("ancestors"),
            F.when(tree, F.concat(F.reverse(lab), F.array(F.coalesce("label", F.lit(""))))).alias("path"),
        )
    )


def descendants(paths: DataFrame) -> DataFrame:
    """ancestor, descendant, distance: one row for each pair, from the result of ``full_paths``.

    As many rows as all depths together; no node's descendants are gathered in one place.
    """
    pairs = paths.where("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode("ancestors").alias("at", "k"))
    return pairs.join(paths.select("k", F.col("id").alias("ancestor")), "k").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))

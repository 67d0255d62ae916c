"""Cutting trees into parts and joining the parts again: edges to cut, two-tree bipartition, recursive
decomposition by size and diameter, and the spanning tree of the parts.

Trees are node tables (node, parent, len, is_leaf) with the ancestor closure of ``trees.ancestors``.
All parts are worked on at once: a round cuts one edge of each part that is still too large. A part
is named by the node that was its root when it was cut off. Ties go to the smaller node number.
Null lengths count as 0 in sums and are no candidates for the longest edge. An empty tree has no parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.lineage import cut, stored
from strandweave.operators.trees import centroid_edge, joined_labels, leaf_counts, longest_edge, min_clusters

STYLES = ("mincluster", "centroid", "longest", "midpoint")


def breaking_edge(tree: DataFrame, closure: DataFrame, kind: str) -> DataFrame:
    """(node) of the edge that ``kind`` (centroid or longest) would cut; another kind raises."""
    if kind == "centroid":
        return centroid_edge(tree, leaf_counts(tree, closure)).select("node")
    if kind == "longest":
        return longest_edge(tree).select("node")
    raise ValueError(f"no such way to choose an edge: {kind}")


def _sum(a: Column, b: Column) -> Column:
    """Null only where both are."""
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def _without_unary(state: DataFrame) -> DataFrame:
    """(part, node, parent, len, is_leaf) without inner nodes of one child: lengths add up, and the
    only child of a root becomes the root. Chains are followed in doubling jumps."""
    kids = state.where("parent is not null").groupBy(F.col("part").alias("__part"), F.col("parent").alias("__node")).agg(F.count("*").alias("__k"))
    one = (F.col("node") == F.col("__node")) & (F.col("part") == F.col("__part"))
    unary = cut(state.join(kids.where("__k = 1"), one, "left_semi").select("part", F.col("node").alias("via"), F.col("parent").alias("up"), F.col("len").alias("more")))
    if unary.isEmpty():
        return state
    jump = unary
    while True:
        further = jump.alias("a").join(unary.select("part", F.col("via").alias("stop")).alias("s"), (F.col("a.part") == F.col("s.part")) & (F.col("a.up") == F.col("s.stop")), "left_semi")
        if further.isEmpty():
            break
        on = (F.col("a.part") == F.col("b.part")) & (F.col("a.up") == F.col("b.via"))
        twice = jump.alias("a").join(jump.alias("b"), on, "left")
        hit = F.col("b.via").isNotNull()
        jump = cut(twice.select("a.part", "a.via", F.when(hit, F.col("b.up")).otherwise(F.col("a.up")).alias("up"), F.when(hit, _sum(F.col("a.more"), F.col("b.more"))).otherwise(F.col("a.more")).alias("more")))
    kept = state.alias("n").join(unary.alias("u"), (F.col("n.part") == F.col("u.part")) & (F.col("n.node") == F.col("u.via")), "left_anti")
    met = kept.join(jump.alias("j"), (F.col("n.part") == F.col("j.part")) & (F.col("n.parent") == F.col("j.via")), "left")
    moved = F.col("j.via").isNotNull()
    length = F.when(moved & F.col("j.up").isNull(), F.lit(None).cast("double")).when(moved, _sum(F.col("n.len"), F.col("j.more"))).otherwise(F.col("n.len"))
    return met.select("n.part", "n.node", F.when(moved, F.col("j.up")).otherwise(F.col("n.parent")).alias("parent"), length.alias("len"), "n.is_leaf")


def _roots_opened(state: DataFrame) -> DataFrame:
    """Roots of two children lose one that is an inner node: its children come to the root, its
    length to the other child."""
    roots = state.where("parent is null").select(F.col("part").alias("__part"), F.col("node").alias("__root"))
    kids = state.join(roots, (F.col("part") == F.col("__part")) & (F.col("parent") == F.col("__root")))
    pairs = kids.groupBy("__part", "__root").agg(F.count("*").alias("k"), F.min(F.when(~F.col("is_leaf"), F.struct("node", "len"))).alias("gone")).where("k = 2 and gone is not null")
    gone = pairs.select(F.col("__part").alias("p"), F.col("__root").alias("root"), F.col("gone.node").alias("gone"), F.col("gone.len").alias("more"))
    met = state.join(gone, state["part"] == gone["p"], "left").where("gone is null or node <> gone")
    parent = F.when(F.col("parent") == F.col("gone"), F.col("root")).otherwise(F.col("parent"))
    length = F.when(F.col("parent") == F.col("root"), _sum(F.col("len"), F.col("more"))).otherwise(F.col("len"))
    return met.select("part", "node", parent.alias("parent"), length.alias("len"), "is_leaf")


def _tidy(state: DataFrame) -> DataFrame:
    return cut(_roots_opened(_without_unary(state)))


def without_unifurcations(tree: DataFrame) -> DataFrame:
    """The tree without inner nodes of one child."""
    return _without_unary(tree.select(F.lit(0).alias("part"), "node", "parent", "len", "is_leaf")).drop("part")


def root_polytomy(tree: DataFrame) -> DataFrame:
    """The tree with a root of three children or more, where an inner child can be opened."""
    return _roots_opened(tree.select(F.lit(0).alias("part"), "node", "parent", "len", "is_leaf")).drop("part")


def _divided(state: DataFrame, closure: DataFrame, cuts: DataFrame) -> DataFrame:
    """The state after ``cuts`` (part, edge): what is below an edge is a part of its own. Parts are
    rid of unifurcations and their roots opened."""
    inside = closure.join(cuts.select(F.col("part").alias("__of"), F.col("edge").alias("anc")), "anc").select(F.col("node").alias("__node"), "__of", F.col("anc").alias("__edge"))
    met = state.join(inside, (F.col("node") == F.col("__node")) & (F.col("part") == F.col("__of")), "left")
    top = F.coalesce(F.col("node") == F.col("__edge"), F.lit(False))
    rows = met.select(F.coalesce("__edge", "part").alias("part"), "node", F.when(~top, F.col("parent")).alias("parent"), F.when(~top, F.col("len")).alias("len"), "is_leaf")
    return _tidy(rows)


def _start(tree: DataFrame) -> DataFrame:
    """One part for each root; all nodes of a tree table are taken as one tree."""
    root = tree.where("parent is null").agg(F.min("node").alias("part"))
    return tree.select("node", "parent", "len", "is_leaf").crossJoin(F.broadcast(root)).select("part", "node", "parent", "len", "is_leaf")


def bipartition_trees(tree: DataFrame, closure: DataFrame, edge: DataFrame) -> DataFrame:
    """(part, node, parent, len, is_leaf): the two trees that cutting ``edge`` (node) leaves.

    The length of the cut edge goes; both are without unifurcations and with opened roots.
    """
    start = _start(tree)
    return _divided(start, closure, start.join(F.broadcast(edge.select(F.col("node").alias("edge"))), F.col("node") == F.col("edge"), "left_semi").select("part", F.col("node").alias("edge")))


def _inside(state: DataFrame, closure: DataFrame) -> DataFrame:
    """(part, leaf, anc, dist, hops) of each part's leaves and their ancestors in it."""
    leaves = state.where("is_leaf").select("part", F.col("node").alias("leaf"))
    nodes = state.select(F.col("part").alias("__part"), F.col("node").alias("anc"))
    return closure.withColumnRenamed("node", "leaf").join(leaves, "leaf").join(nodes, "anc").where("part = __part").drop("__part")


def _reaches(state: DataFrame, within: DataFrame) -> DataFrame:
    """(part, top, diameter, leaf) of each part: where its longest way turns, and that way's far end."""
    far = within.groupBy("part", F.col("anc").alias("node")).agg(F.max(F.struct("dist", (-F.col("leaf")).alias("l"))).alias("far"))
    kids = state.where("parent is not null").join(far, ["part", "node"])
    reach = F.struct((F.coalesce("len", F.lit(0.0)) + F.col("far.dist")).alias("d"), F.col("far.l").alias("l"))
    two = kids.groupBy("part", "parent").agg(F.sort_array(F.collect_list(reach), asc=False).alias("r")).select("part", F.col("parent").alias("top"), F.get("r", 0).alias("a"), F.get("r", 1).alias("b"))
    ways = two.select("part", "top", (F.col("a.d") + F.coalesce("b.d", F.lit(0.0))).alias("diameter"), (-F.col("a.l")).alias("leaf"))
    return ways.groupBy("part").agg(F.max(F.struct("diameter", (-F.col("top")).alias("t"), "leaf")).alias("w")).select("part", (-F.col("w.t")).alias("top"), "w.diameter", "w.leaf")


def _edges(style: str, state: DataFrame, within: DataFrame, least: int) -> DataFrame:
    """(part, edge): the edge of each part that ``style`` cuts, if both sides have ``least`` leaves."""
    below = within.groupBy("part", F.col("anc").alias("node")).agg(F.count("*").alias("below"))
    sizes = state.where("is_leaf").groupBy(F.col("part").alias("__part")).agg(F.count("*").alias("n"))
    open_ = state.where("parent is not null").join(below, ["part", "node"]).join(sizes, F.col("part") == F.col("__part")).where((F.col("below") >= least) & (F.col("n") - F.col("below") >= least))
    middle = F.struct(F.lit(1).alias("k"), F.abs(F.col("n") / 2 - F.col("below")).alias("off"), "node")
    if style == "longest":
        rank = F.when(F.col("len").isNotNull(), F.struct(F.lit(0).alias("k"), (-F.col("len")).alias("off"), "node")).otherwise(middle)
    elif style == "midpoint":
        way = _reaches(state, within).select(F.col("part").alias("__p"), "top", "diameter", F.col("leaf").alias("__l"))
        up = within.join(way, (F.col("part") == F.col("__p")) & (F.col("leaf") == F.col("__l"))).where("anc <> top and 2 * dist <= diameter")
        chosen = up.groupBy(F.col("part").alias("__p")).agg(F.max_by("anc", "hops").alias("__half"))
        open_ = open_.join(chosen, F.col("part") == F.col("__p"), "left")
        rank = F.when(F.col("node") == F.col("__half"), F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("off"), "node")).otherwise(middle)
    else:
        rank = middle
    return open_.groupBy("part").agg(F.min(rank).alias("e")).select("part", F.col("e.node").alias("edge"))


def decompose(tree: DataFrame, closure: DataFrame, most: int, style: str = "mincluster", least: int = 1, most_diameter: float | None = None) -> DataFrame:
    """(leaf, subset): every leaf in a part of at most ``most`` leaves.

    mincluster cuts bottom-up into the fewest parts. The other styles cut one edge of each part
    that has more leaves, or a longer way between two of them than ``most_diameter``: the one that
    halves the leaves best, the longest one, or that in the middle of the part's longest way (the
    last two fall back to the first). Where no edge leaves ``least`` leaves on both sides the part
    stays as it is; no leaf is ever lost.
    """
    if style not in STYLES:
        raise ValueError(f"no such style: {style}")
    if most < 2:
        raise ValueError(f"a part must have room for two leaves: {most}")
    if style == "mincluster":
        return min_clusters(tree, closure, most).select("leaf", F.col("cluster").alias("subset"))
    state = _tidy(_start(tree))
    while True:
        within = cut(_inside(state, closure))
        large = state.where("is_leaf").groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > most).select("part")
        if most_diameter is not None:
            large = large.union(_reaches(state, within).where(F.col("diameter") > most_diameter).select("part")).distinct()
        some = state.join(large, "part", "left_semi")
        cuts = cut(_edges(style, some, within.join(large, "part", "left_semi"), least))
        if cuts.isEmpty():
            return state.where("is_leaf").select(F.col("node").alias("leaf"), F.col("part").alias("subset"))
        state = _divided(state, closure, cuts)


def bisect(tree: DataFrame, closure: DataFrame, style: str, most: int = 2, least: int = 1) -> DataFrame:
    """(part, node, parent, len, is_leaf): one cut by ``style``; one part if no edge can be cut.

    mincluster cuts the largest child of the first node that has more than ``most`` leaves and no
    such child.
    """
    if style not in STYLES:
        raise ValueError(f"no such style: {style}")
    start = _start(tree)
    if style != "mincluster":
        state = _tidy(start)
        return _divided(state, closure, cut(_edges(style, state, _inside(state, closure), least)))
    counts = cut(tree.select("node", "parent").join(leaf_counts(tree, closure), "node"))
    over = counts.where(F.col("n_leaves") > most)
    first = over.join(over.select(F.col("parent").alias("up")), F.col("node") == F.col("up"), "left_anti").agg(F.min("node").alias("parent"))
    edge = counts.join(F.broadcast(first), "parent").orderBy(F.desc("n_leaves"), "node").limit(1).select("node")
    return bipartition_trees(tree, closure, edge)


def subset_tree(tree: DataFrame, closure: DataFrame, subsets: DataFrame) -> DataFrame:
    """(a, b, len): a spanning tree of the subsets of (leaf, subset), each the leaves of a connected
    part of the tree named by its root.

    Two subsets are joined where an edge leads from one to the other. A part without leaves of its
    own goes, with its shortest edge, to a neighbour; null lengths are shortest.
    """
    marks = subsets.select(F.col("subset").alias("anc")).distinct().union(tree.where("parent is null").select("node")).distinct()
    near = closure.join(marks, "anc").groupBy("node").agg(F.min_by("anc", "hops").alias("part"))
    own = stored(near)
    up = own.select(F.col("node").alias("parent"), F.col("part").alias("above"))
    edges = stored(tree.join(own, "node").join(up, "parent").where("part <> above").select(F.least("part", "above").alias("a"), F.greatest("part", "above").alias("b"), F.coalesce("len", F.lit(-1.0)).alias("len")))
    filled = stored(subsets.select(F.col("subset").alias("node")).distinct())
    label = stored(own.select(F.col("part").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        la, lb = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = edges.join(la, "a").join(lb, "b").where("la <> lb")
        full = label.join(filled, "node", "left_semi").select(F.col("label").alias("full")).distinct()
        edge = F.struct("len", "a", "b", "la", "lb")
        both = between.select(F.col("la").alias("label"), edge.alias("e")).union(between.select("lb", edge))
        best = stored(both.join(full, F.col("label") == F.col("full"), "left_anti").groupBy("label").agg(F.min("e").alias("e")).select("label", "e.*"))
        if best.isEmpty():
            break
        label = stored(joined_labels(label, best))
    # a joined part bears the name of the one subset in it
    name = label.join(filled, "node", "left_semi").select(F.col("label").alias("__label"), F.col("node").alias("name"))
    named = label.join(name, F.col("label") == F.col("__label")).select("node", "name")
    na, nb = named.select(F.col("node").alias("a"), F.col("name").alias("x")), named.select(F.col("node").alias("b"), F.col("name").alias("y"))
    return edges.join(na, "a").join(nb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("len") >= 0, F.col("len")).alias("len"))


def group_roots(closure: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, root, n_leaves): the lowest node that has all leaves of each group of (leaf, group) below it."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("n_leaves"))
    above = groups.join(closure.withColumnRenamed("node", "leaf"), "leaf").groupBy("group", "anc").agg(F.count("*").alias("n"), F.max("hops").alias("far"))
    return above.join(sizes, "group").where("n = n_leaves").groupBy("group").agg(F.min_by("anc", "far").alias("root"), F.first("n_leaves").alias("n_leaves"))


def group_sets(closure: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, groups): the sorted groups of (leaf, group) that stand below each node, or at it."""
    below = closure.withColumnRenamed("node", "leaf").join(groups, "leaf")
    return below.groupBy(F.col("anc").alias("node")).agg(F.array_sort(F.collect_set("group")).alias("groups"))


def rooted(edges: DataFrame, root: int) -> DataFrame:
    """(node, parent) of the undirected tree of ``edges`` (a, b), hung from ``root``; rounds grow with log n.

    The tree is walked round as a tour of its arcs, whose places are found by doubling; an arc that
    comes before its opposite leads away from the root.
    """
    from pyspark.sql import Window

    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    turn = Window.partitionBy("u").orderBy("v")
    after = F.coalesce(F.lead("v").over(turn), F.first("v").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # behind the arc (v, u) the tour leaves u for the neighbour behind v
    tour = both.select(F.col("v").alias("x"), F.col("u").alias("y"), after.alias("z"))
    last = F.when(F.col("y") == root, F.max(F.when(F.col("y") == root, F.col("x"))).over(Window.partitionBy("y")))
    ends = F.coalesce(F.col("x") == last, F.lit(False))
    jump = cut(tour.select("x", "y", F.when(~ends, F.col("y")).alias("nx"), F.when(~ends, F.col("z")).alias("ny"), F.when(ends, 0).otherwise(1).cast("long").alias("left")))
    while not jump.where("nx is not null").isEmpty():
        a, b = jump.alias("a"), jump.alias("b")
        met = a.join(b, (F.col("a.nx") == F.col("b.x")) & (F.col("a.ny") == F.col("b.y")), "left")
        jump = cut(met.select("a.x", "a.y", F.col("b.nx").alias("nx"), F.col("b.ny").alias("ny"), (F.col("a.left") + F.coalesce("b.left", F.lit(0))).alias("left")))
    a, b = jump.alias("a"), jump.alias("b")
    down = a.join(b, (F.col("a.x") == F.col("b.y")) & (F.col("a.y") == F.col("b.x"))).where("a.left > b.left")
    top = edges.sparkSession.range(1).select(F.lit(root).cast(dict(edges.dtypes)["a"]).alias("node"), F.lit(None).cast(dict(edges.dtypes)["a"]).alias("parent"))
    return down.select(F.col("a.y").alias("node"), F.col("a.x").alias("parent")).union(top)

"""Trees as node tables (node, parent, len, is_leaf) and what is computed on them.

Ties go to the smaller node number, which stands in for the place in post-order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.lineage import cut


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, anc, dist, hops) of every node and each of its ancestors, itself included.

    Jumps double each round, so the rounds grow with the logarithm of the depth.
    """
    jump = tree.where("parent is not null").select("node", F.col("parent").alias("anc"), F.coalesce("len", F.lit(0.0)).alias("dist"), F.lit(1).alias("hops"))
    found = tree.select("node", F.col("node").alias("anc"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"))
    while not jump.isEmpty():
        further = found.alias("a").join(jump.alias("b"), F.col("a.anc") == F.col("b.node"))
        found = cut(found.union(further.select("a.node", "b.anc", (F.col("a.dist") + F.col("b.dist")).alias("dist"), (F.col("a.hops") + F.col("b.hops")).alias("hops"))))
        twice = jump.alias("a").join(jump.alias("b"), F.col("a.anc") == F.col("b.node"))
        jump = cut(twice.select("a.node", "b.anc", (F.col("a.dist") + F.col("b.dist")).alias("dist"), (F.col("a.hops") + F.col("b.hops")).alias("hops")))
    return found


def leaf_counts(tree: DataFrame, closure: DataFrame) -> DataFrame:
    """(node, n_leaves) of every node."""
    leaves = tree.where("is_leaf").select("node")
    return closure.join(leaves, "node", "left_semi").groupBy(F.col("anc").alias("node")).agg(F.count("*").alias("n_leaves"))


def centroid_edge(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """The edge that halves the leaves best: (node, n_leaves, off)."""
    n = tree.where("is_leaf").agg(F.count("*").alias("n"))
    below = tree.where("parent is not null").select("node").join(counts, "node").crossJoin(F.broadcast(n))
    return below.select("node", "n_leaves", F.abs(F.col("n") / 2 - F.col("n_leaves")).alias("off")).orderBy("off", "node").limit(1)


def longest_edge(tree: DataFrame, internal: bool = False) -> DataFrame:
    """The longest edge, or the longest that leads to an inner node: (node, len)."""
    edges = tree.where("parent is not null and len is not null")
    edges = edges.where("not is_leaf") if internal else edges
    return edges.select("node", "len").orderBy(F.desc("len"), "node").limit(1)


def bipartition(tree: DataFrame, closure: DataFrame, edge: DataFrame) -> DataFrame:
    """(leaf, inside): whether each leaf is below ``edge`` (one row: node); none is where there is no edge."""
    under = closure.join(F.broadcast(edge.select(F.col("node").alias("anc"))), "anc", "left_semi").select("node", F.lit(True).alias("below"))
    return tree.where("is_leaf").select("node").join(under, "node", "left").select(F.col("node").alias("leaf"), F.coalesce("below", F.lit(False)).alias("inside"))


def valid(tree: DataFrame) -> DataFrame:
    """(n_children, valid) of the root: one child must be an inner node, two must both be leaves."""
    root = tree.where("parent is null").select(F.col("node").alias("parent"))
    kids = tree.join(F.broadcast(root), "parent", "left_semi").agg(F.count("*").alias("n_children"), F.count_if("is_leaf").alias("leaves"))
    rule = F.when(F.col("n_children") == 1, F.col("leaves") == 0).when(F.col("n_children") == 2, F.col("leaves") == 2).otherwise(F.lit(True))
    return kids.select("n_children", rule.alias("valid"))


def min_clusters(tree: DataFrame, closure: DataFrame, most: int) -> DataFrame:
    """(leaf, cluster): the fewest subtrees of at most ``most`` leaves by cutting bottom-up.

    At each node the largest child is detached while the leaves left below exceed ``most``. Levels
    are worked from the deepest up, all nodes of a level at once; a cluster is named by its root.
    """
    depth = closure.groupBy("node").agg(F.max("hops").alias("depth"))
    rest = cut(tree.join(depth, "node").select("node", "parent", "depth", "is_leaf"))
    deepest = rest.agg(F.max("depth")).first()[0]
    if deepest is None:
        return tree.select(F.col("node").alias("leaf"), F.col("node").alias("cluster")).where("false")
    detached = None
    carried = None  # (node, n) of the level below
    for level in range(deepest, -1, -1):
        own = rest.where(F.col("depth") == level)
        sums = own.join(carried.withColumnRenamed("node", "kid"), own["node"] == carried["up"], "left").groupBy("node", "parent", "is_leaf").agg(F.sum("n").alias("below")) if carried is not None else own.withColumn("below", F.lit(None).cast("long"))
        sized = sums.select("node", "parent", F.when(F.col("is_leaf"), F.lit(1).cast("long")).otherwise(F.coalesce("below", F.lit(0))).alias("n"))
        kin = Window.partitionBy("parent")
        before = kin.orderBy(F.desc("n"), "node").rowsBetween(Window.unboundedPreceding, -1)
        judged = cut(sized.select("node", "parent", "n", (F.sum("n").over(kin) - F.coalesce(F.sum("n").over(before), F.lit(0)) > most).alias("off")))
        if level:
            gone = judged.where("off").select("node")
            detached = gone if detached is None else detached.union(gone)
            carried = judged.where("not off").select("node", F.col("parent").alias("up"), "n")
    return _clusters(tree, closure, detached if detached is not None else tree.select("node").where("false"))


def _clusters(tree: DataFrame, closure: DataFrame, marks: DataFrame) -> DataFrame:
    """(leaf, cluster): the nearest marked ancestor of each leaf; the root is marked."""
    roots = tree.where("parent is null").select("node")
    anc = marks.union(roots).select(F.col("node").alias("anc")).distinct()
    near = closure.join(anc, "anc").join(tree.where("is_leaf").select("node"), "node", "left_semi")
    return near.groupBy(F.col("node").alias("leaf")).agg(F.min_by("anc", "hops").alias("cluster"))


def diameter_clusters(tree: DataFrame, closure: DataFrame, most: float) -> DataFrame:
    """(leaf, cluster): subtrees in which no two leaves are farther apart than ``most``, by cutting bottom-up.

    At each node the deepest child is cut while it and the next reach farther together. Of children
    in order of depth that is each one that exceeds ``most`` with its successor.
    """
    depth = closure.groupBy("node").agg(F.max("hops").alias("level"))
    rest = cut(tree.join(depth, "node").select("node", "parent", F.coalesce("len", F.lit(0.0)).alias("len"), "is_leaf", "level"))
    deepest = rest.agg(F.max("level")).first()[0]
    marks, below = None, None
    for level in range(deepest or 0, -1, -1):
        own = rest.where(F.col("level") == level)
        reach = own.withColumn("below", F.lit(None).cast("double")) if below is None else own.join(below, own["node"] == below["up"], "left")
        # an inner node that has lost all children reaches nothing
        far = reach.select("node", "parent", (F.col("len") + F.when(F.col("is_leaf"), 0.0).otherwise(F.coalesce("below", F.lit(0.0)))).alias("far"))
        kin = Window.partitionBy("parent").orderBy(F.desc("far"), "node")
        judged = cut(far.select("node", "parent", "far", F.coalesce(F.col("far") + F.lead("far").over(kin) > most, F.lit(False)).alias("off")))
        if level:
            gone = judged.where("off").select("node")
            marks = gone if marks is None else marks.union(gone)
            below = judged.where("not off").groupBy(F.col("parent").alias("up")).agg(F.max("far").alias("below"))
    return _clusters(tree, closure, marks if marks is not None else tree.select("node").where("false"))


def subtree_diameters(tree: DataFrame, closure: DataFrame) -> DataFrame:
    """(node, depth, diameter) of every node with leaves: to its farthest leaf, and between the two
    farthest leaves of different children."""
    leaves = tree.where("is_leaf").select("node")
    reach = closure.join(leaves, "node", "left_semi").groupBy(F.col("anc").alias("node")).agg(F.max("dist").alias("depth"))
    kids = tree.where("parent is not null").join(reach, "node").select("parent", "node", (F.coalesce("len", F.lit(0.0)) + F.col("depth")).alias("far"))
    place = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("far"), "node"))
    two = kids.withColumn("place", place).where("place <= 2").groupBy(F.col("parent").alias("up")).agg(F.sum("far").alias("diameter"))
    return reach.join(two, reach["node"] == two["up"], "left").select("node", "depth", F.coalesce("diameter", F.lit(0.0)).alias("diameter"))


def degrees(tree: DataFrame) -> DataFrame:
    """(node, n_children, n_adjacent) of every node."""
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return tree.join(kids, tree["node"] == kids["up"], "left").select("node", n.alias("n_children"), (n + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("n_adjacent"))


def group_distances(closure: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, distance) for groups a < b of (leaf, root): mean distance of each group's leaves to its
    root, both added to the path between the roots."""
    own = groups.join(closure.withColumnRenamed("node", "leaf"), "leaf").where("anc = root").groupBy("root").agg(F.avg("dist").alias("mean"))
    up = own.join(closure, own["root"] == closure["node"]).select("root", "mean", "anc", "dist")
    a, b = up.alias("a"), up.alias("b")
    met = a.join(b, (F.col("a.anc") == F.col("b.anc")) & (F.col("a.root") < F.col("b.root")))
    path = F.min(F.col("a.dist") + F.col("b.dist"))
    return met.groupBy(F.col("a.root").alias("a"), F.col("b.root").alias("b")).agg((path + F.first("a.mean") + F.first("b.mean")).alias("distance"))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(a, b, distance) of the minimum spanning tree, in rounds: each component takes its shortest edge.

    Ties go to the smaller (a, b), so the tree is that of sorting all edges.
    """
    edges = cut(edges.select("a", "b", "distance"))
    label = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    chosen = None
    while True:
        la, lb = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = edges.join(la, "a").join(lb, "b").where("la <> lb")
        edge = F.struct("distance", "a", "b", "la", "lb")
        best = cut(between.select(F.col("la").alias("label"), edge.alias("e")).union(between.select("lb", edge)).groupBy("label").agg(F.min("e").alias("e")).select("label", "e.*"))
        if best.isEmpty():
            break
        picked = best.select("a", "b", "distance").distinct()
        chosen = picked if chosen is None else chosen.union(picked)
        label = cut(joined_labels(label, best))
    return edges.where("false") if chosen is None else chosen


def joined_labels(label: DataFrame, best: DataFrame) -> DataFrame:
    """Labels after the components of each chosen edge are one: the smallest label reachable."""
    links = cut(best.select(F.col("la").alias("u"), F.col("lb").alias("v")).union(best.select("lb", "la")).distinct())
    least = cut(links.select("u").distinct().withColumn("m", F.col("u")))
    while True:
        told = links.join(least.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("m").alias("near"))
        new = cut(least.join(told, "u").select("u", F.least("m", "near").alias("m"), (F.col("near") < F.col("m")).alias("moved")))
        if not new.where("moved").head(1):
            break
        least = new.drop("moved")
    return label.join(least, label["label"] == least["u"], "left").select("node", F.coalesce("m", "label").alias("label"))


def label_mismatch(tree_labels: DataFrame, taxa: DataFrame) -> DataFrame:
    """(label, side): labels that only the tree (``extra``) or only the sequences (``missing``) have."""
    extra = tree_labels.select("label").distinct().join(taxa.select(F.col("taxon").alias("label")), "label", "left_anti")
    missing = taxa.select(F.col("taxon").alias("label")).distinct().join(tree_labels, "label", "left_anti")
    return extra.select("label", F.lit("extra").alias("side")).union(missing.select("label", F.lit("missing").alias("side")))


def resolve_polytomies(tree: DataFrame) -> DataFrame:
    """(node, parent, len, is_leaf) with at most two children per node, three at the root.

    Surplus children are attached below new nodes of length 0, as evenly as a heap: of n children,
    number i hangs under number i // 2, so depth grows with the logarithm of n. New numbers follow
    the largest old one; the same tree is resolved alike each time.
    """
    own = Window.partitionBy("parent")
    kids = tree.where("parent is not null").select("node", "parent", "len", "is_leaf", (F.row_number().over(own.orderBy("node")) - 1).alias("r"), F.count("*").over(own).alias("k"))
    root = tree.where("parent is null").select(F.col("node").alias("root"))
    top = F.max(F.col("node")).alias("top")
    sizes = kids.select("parent", "k").distinct().join(F.broadcast(root), F.col("parent") == F.col("root"), "left")
    spared = F.when(F.col("root").isNotNull(), 1).otherwise(0)
    wide = sizes.where(F.col("k") > 2 + spared).select("parent", spared.alias("spared"), (F.col("k") - spared).alias("n"))
    before = Window.orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)
    based = wide.crossJoin(F.broadcast(tree.agg(top))).select("parent", "spared", "n", (F.col("top") + 1 + F.coalesce(F.sum(F.col("n") - 2).over(before), F.lit(0))).alias("base"))

    def above(i):  # the node that number i hangs under
        up = F.floor(i / 2)
        return F.when(up == 1, F.col("parent")).otherwise(F.col("base") + up - 2).cast("int")

    moved = kids.join(based, "parent", "left")
    parent = F.when(F.col("n").isNull() | (F.col("r") < F.col("spared")), F.col("parent")).otherwise(above(F.col("n") + F.col("r") - F.col("spared")))
    old = moved.select("node", parent.alias("parent"), "len", "is_leaf")
    made = based.where("n > 2").select("parent", "base", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n") - 1)).alias("i"))
    new = made.select((F.col("base") + F.col("i") - 2).cast("int").alias("node"), above(F.col("i")).alias("parent"), F.lit(0.0).alias("len"), F.lit(False).alias("is_leaf"))
    return tree.where("parent is null").select("node", "parent", "len", "is_leaf").union(old).union(new)

"""Groups of leaves placed on a tree so that as few edges as possible lead from one group to another.

Two passes over the levels of the tree: upward each node keeps the groups that the most of its children
keep (of two children: those of both, else those of either), downward each takes its parent's group
where it keeps it, else the smallest that it keeps. Both are a join and an aggregate a level, all nodes of
a level at once; a wide node's children are counted within tasks first. The jobs grow with the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.lineage import cut
from strandweave.operators.tours import depths


def kept_groups(tree: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, group, depth): the groups that each node keeps on the way up; a leaf has those that (leaf, group)
    gives it. Leaves without a group, and nodes above none with one, keep nothing."""
    level = depths(tree).select(F.col("node").alias("__node"), F.col("depth").cast("int").alias("depth"))
    rows = cut(tree.join(level, F.col("node") == F.col("__node")).select("node", "parent", "depth", "is_leaf"))
    deepest = rows.agg(F.max("depth")).first()[0]
    own = cut(rows.where("is_leaf").join(groups.select(F.col("leaf").alias("node"), "group").where("group is not null").distinct(), "node").select("node", "parent", "group", "depth"))
    found = own
    below = None
    for k in range(deepest or 0, 0, -1):
        here = own.where(F.col("depth") == k)
        here = here if below is None else here.union(below)
        votes = here.groupBy("parent", "group").agg(F.count("*").alias("n"))
        most = votes.groupBy(F.col("parent").alias("__parent")).agg(F.max("n").alias("most"))
        wins = votes.join(most, (F.col("parent") == F.col("__parent")) & (F.col("n") == F.col("most"))).select(F.col("parent").alias("node"), "group")
        up = rows.where(F.col("depth") == k - 1).select(F.col("node").alias("__node"), F.col("parent").alias("parent"), "depth")
        below = cut(wins.join(up, F.col("node") == F.col("__node")).select("node", "parent", "group", "depth"))
        found = found.union(below)
    return found.select("node", "group", "depth")


def placed_groups(tree: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, group, enters): one group for each node that keeps any, and whether it is another than its parent's.

    The root enters its own. Of leaves that bear several groups the parent's counts if it is one of them.
    """
    kept = cut(kept_groups(tree, groups))
    above = tree.select(F.col("node").alias("__node"), F.col("parent").alias("up"))
    sets = cut(kept.groupBy("node", "depth").agg(F.array_sort(F.collect_set("group")).alias("groups")).join(above, F.col("node") == F.col("__node")).drop("__node"))
    deepest = sets.agg(F.max("depth")).first()[0]
    last = cut(sets.where("depth = 0").select("node", F.get("groups", 0).alias("group"), F.lit(True).alias("enters")))
    out = last
    for k in range(1, (deepest or 0) + 1):
        over = last.select(F.col("node").alias("__up"), F.col("group").alias("__group"))
        met = sets.where(F.col("depth") == k).join(over, F.col("up") == F.col("__up"))
        group = F.when(F.array_contains("groups", F.col("__group")), F.col("__group")).otherwise(F.get("groups", 0))
        last = cut(met.select("node", group.alias("group"), (group != F.col("__group")).alias("enters")))
        out = out.union(last)
    return out


def group_tops(tree: DataFrame, placed: DataFrame) -> DataFrame:
    """(group, node): where a path from the root enters each group, of several such nodes the smallest."""
    return placed.where("enters").groupBy("group").agg(F.min("node").alias("node"))

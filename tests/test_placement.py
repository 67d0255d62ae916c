"""Placed groups against the least number of changes that any placing has."""

import random
from functools import lru_cache

from strandweave.operators import placement as G

SCHEMA = "node int, parent int, len double, is_leaf boolean"


def test_no_placing_has_fewer_changes(spark):
    rnd = random.Random(7)
    rows, groups, shift = [], {}, 0
    for _ in range(12):  # a dozen small trees below one root each, told apart by their numbers
        n = rnd.randint(2, 9)
        parents = {0: None} | {k: rnd.randrange(max(0, k - 3), k) for k in range(1, n)}
        inner = set(parents.values())
        rows += [(shift + v, None if p is None else shift + p, 1.0, v not in inner) for v, p in parents.items()]
        groups |= {shift + v: rnd.choice("abc") for v in parents if v not in inner}
        shift += 100
    got = {r["node"]: (r["group"], r["enters"]) for r in G.placed_groups(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(groups.items()), "leaf int, group string")).collect()}
    up = {v: p for v, p, _, _ in rows}
    kids = {}
    for v, p in up.items():
        kids.setdefault(p, []).append(v)

    @lru_cache(None)
    def least(v, g):
        if v in groups:
            return 0 if groups[v] == g else 10**6
        return sum(min(least(k, h) + (g != h) for h in "abc") for k in kids[v])

    for root in kids[None]:
        tree = [v for v in up if v // 100 == root // 100]
        assert sum(got[v][0] != got[up[v]][0] for v in tree if up[v] is not None) == min(least(root, g) for g in "abc")
        assert all(got[v][1] == (up[v] is None or got[v][0] != got[up[v]][0]) for v in tree) and all(got[v][0] == groups[v] for v in tree if v in groups)
    tree = spark.createDataFrame(rows[:1], SCHEMA)
    assert G.placed_groups(tree, spark.createDataFrame([], "leaf int, group string")).collect() == []
    assert G.placed_groups(tree.where("false"), spark.createDataFrame([], "leaf int, group string")).collect() == []

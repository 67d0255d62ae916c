"""Cutting trees into parts, against plain Python."""

import random

import pytest
from test_trees import frame, grown

from strandweave.operators import decompose as D
from strandweave.operators import trees as T


def leaves_of(kids, n):
    return {n} if not kids[n] else set().union(*(leaves_of(kids, k) for k in kids[n]))


def table(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["part"], {})[r["node"]] = (r["parent"], r["len"], r["is_leaf"])
    return out


def total(nodes):
    return sum(ln or 0.0 for _, ln, _ in nodes.values())


@pytest.mark.parametrize("seed", [1, 8])
def test_two_trees(spark, seed):
    rows, kids = grown(seed, 15)
    tree = frame(spark, rows)
    closure = T.ancestors(tree)
    length = {n: ln or 0.0 for n, _, ln, _ in rows}
    for kind in ("centroid", "longest"):
        edge = D.breaking_edge(tree, closure, kind).first()["node"]
        parts = table(D.bipartition_trees(tree, closure, D.breaking_edge(tree, closure, kind)))
        inside = leaves_of(kids, edge)
        found = {p: {n for n, (_, _, leaf) in nodes.items() if leaf} for p, nodes in parts.items()}
        assert found == {edge: inside, 0: leaves_of(kids, 0) - inside}
        assert abs(sum(map(total, parts.values())) - (sum(length.values()) - length[edge])) < 1e-9
        for nodes in parts.values():
            n_kids = [sum(p == n for p, _, _ in nodes.values()) for n in nodes if not nodes[n][2]]
            assert len(nodes) == 1 or (min(n_kids) >= 2 and sum(p is None for p, _, _ in nodes.values()) == 1)
    with pytest.raises(ValueError, match="no such way"):
        D.breaking_edge(tree, closure, "shortest")


@pytest.mark.parametrize("style,least", [("centroid", 1), ("longest", 3), ("midpoint", 2), ("mincluster", 1)])
def test_decomposition_keeps_every_leaf(spark, style, least):
    rows, kids = grown(5, 18)
    tree = frame(spark, rows)
    closure = T.ancestors(tree)
    subsets = D.decompose(tree, closure, 7, style, least).cache()
    got = {r["leaf"]: r["subset"] for r in subsets.collect()}
    assert set(got) == leaves_of(kids, 0)
    sizes = {s: sum(x == s for x in got.values()) for s in got.values()}
    assert len(sizes) > 1 and min(sizes.values()) >= least and (style != "centroid" or max(sizes.values()) <= 7)
    # the subsets are joined by one edge less than there are of them, and all hang together
    edges = [(r["a"], r["b"]) for r in D.subset_tree(tree, closure, subsets).collect()]
    assert len(edges) == len(sizes) - 1 and {x for e in edges for x in e} <= set(sizes)
    seen, todo = set(), [next(iter(sizes))]
    while todo:
        x = todo.pop()
        seen.add(x)
        todo += [b if a == x else a for a, b in edges if x in (a, b) and not {a, b} <= seen]
    assert seen == set(sizes)


def test_one_cut_halves_best(spark):
    rows, kids = grown(9, 14)
    tree = frame(spark, rows)
    n = len(leaves_of(kids, 0))
    off = min((abs(n / 2 - len(leaves_of(kids, k))), k) for k in kids if k)
    got = {r["leaf"]: r["subset"] for r in D.decompose(tree, T.ancestors(tree), n - 1, "centroid").collect()}
    assert abs(n / 2 - sum(x != 0 for x in got.values())) == off[0] and len(set(got.values())) == 2


def test_diameter_and_least(spark):
    rows, kids = grown(3, 12)
    tree = frame(spark, rows)
    closure = T.ancestors(tree)
    got = {r["leaf"]: r["subset"] for r in D.decompose(tree, closure, 12, "midpoint", most_diameter=16.0).collect()}
    length, parent = {n: ln or 0.0 for n, _, ln, _ in rows}, {n: p for n, p, _, _ in rows}

    def up(n):
        out, d = {}, 0.0
        while n is not None:
            out[n] = d
            d, n = d + length[n], parent[n]
        return out

    for a in got:
        for b in got:
            if got[a] == got[b]:
                assert min(up(a)[x] + up(b)[x] for x in up(a) if x in up(b)) <= 16.0
    few = D.decompose(tree, closure, 2, "longest", least=4).groupBy("subset").count().collect()
    assert min(r["count"] for r in few) >= 4
    with pytest.raises(ValueError, match="room for two"):
        D.decompose(tree, closure, 1)
    with pytest.raises(ValueError, match="no such style"):
        D.decompose(tree, closure, 9, "other")


def test_bisect_by_mincluster(spark):
    rows, kids = grown(6, 20)
    tree = frame(spark, rows)
    n = {k: len(leaves_of(kids, k)) for k in kids}
    first = min(k for k in kids if n[k] > 5 and all(n[c] <= 5 for c in kids[k]))
    child = min(kids[first], key=lambda c: (-n[c], c))
    parts = table(D.bisect(tree, T.ancestors(tree), "mincluster", most=5))
    assert {x for x, (_, _, leaf) in parts[child].items() if leaf} == leaves_of(kids, child) and set(parts) == {0, child}


def test_unary_chains_and_roots(spark):
    tree = frame(spark, [(0, None, None, False), (1, 0, 1.0, False), (2, 1, 2.0, False), (3, 2, 4.0, False), (4, 3, 1.0, True), (5, 3, 1.0, True), (6, 1, None, False), (7, 6, None, True)])
    got = {r["node"]: (r["parent"], r["len"]) for r in D.without_unifurcations(tree).collect()}
    assert got == {1: (None, None), 3: (1, 6.0), 4: (3, 1.0), 5: (3, 1.0), 7: (1, None)}
    got = {r["node"]: (r["parent"], r["len"]) for r in D.root_polytomy(D.without_unifurcations(tree)).collect()}
    assert got == {1: (None, None), 4: (1, 1.0), 5: (1, 1.0), 7: (1, 6.0)}


def test_groups(spark):
    rows, kids = grown(4, 20)
    tree = frame(spark, rows)
    closure = T.ancestors(tree)
    tops = [k for k in kids[0]]
    groups = spark.createDataFrame([(x, f"g{k}") for k in tops for x in leaves_of(kids, k)], "leaf int, group string")
    assert {r["group"]: (r["root"], r["n_leaves"]) for r in D.group_roots(closure, groups).collect()} == {f"g{k}": (k, len(leaves_of(kids, k))) for k in tops}
    sets = {r["node"]: r["groups"] for r in D.group_sets(closure, groups).collect()}
    assert sets[0] == sorted(f"g{k}" for k in tops) and all(len(v) == 1 for n, v in sets.items() if n)


def test_rooted(spark):
    rnd = random.Random(2)
    parent = {n: rnd.randrange(n) for n in range(1, 40)}
    edges = spark.createDataFrame([(a, b) if rnd.random() < 0.5 else (b, a) for a, b in parent.items()], "a int, b int")
    assert {r["node"]: r["parent"] for r in D.rooted(edges, 0).collect()} == {0: None, **parent}
    again = {r["node"]: r["parent"] for r in D.rooted(edges, 17).collect()}
    at, way = 17, []
    while at is not None:
        way.append(at)
        at = parent.get(at)
    assert again == {0: None, **parent} | {b: a for a, b in zip([None, *way], way)}

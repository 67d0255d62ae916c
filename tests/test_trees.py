"""Tree operators against plain Python."""

import itertools
import random

import pytest

from strandweave.operators import trees as T


def grown(seed, leaves=30):
    """A random tree as (node, parent, len, is_leaf), root 0."""
    rnd = random.Random(seed)
    parent, kids = {0: None}, {0: []}
    while sum(not k for k in kids.values()) < leaves:
        at = rnd.choice([n for n in kids if not kids[n]])
        for _ in range(rnd.randint(2, 4)):
            new = len(parent)
            parent[new], kids[new] = at, []
            kids[at].append(new)
    return [(n, p, None if p is None else rnd.randint(1, 9) * 1.0, not kids[n]) for n, p in parent.items()], kids


def frame(spark, rows):
    return spark.createDataFrame(rows, "node int, parent int, len double, is_leaf boolean")


def below(kids, n):
    return 1 if not kids[n] else sum(below(kids, k) for k in kids[n])


def test_leaf_counts_and_centroid(spark):
    rows, kids = grown(1)
    tree = frame(spark, rows)
    closure = T.ancestors(tree)
    counts = {r["node"]: r["n_leaves"] for r in T.leaf_counts(tree, closure).collect()}
    assert counts == {n: below(kids, n) for n in kids}
    n = counts[0]
    assert T.centroid_edge(tree, T.leaf_counts(tree, closure)).first()["node"] == min((abs(n / 2 - counts[k]), k) for k in kids if k)[1]


@pytest.mark.parametrize("seed,most", [(2, 5), (3, 3)])
def test_min_clusters(spark, seed, most):
    rows, kids = grown(seed)
    tree = frame(spark, rows)
    off = set()

    def rest(n):
        if not kids[n]:
            return 1
        own = sorted(((rest(k), k) for k in kids[n]), key=lambda x: (-x[0], x[1]))
        while sum(x for x, _ in own) > most:
            off.add(own.pop(0)[1])
        return sum(x for x, _ in own)

    rest(0)
    parent = {n: p for n, p, _, _ in rows}

    def cluster(n):
        return n if n in off or n == 0 else cluster(parent[n])

    got = {r["leaf"]: r["cluster"] for r in T.min_clusters(tree, T.ancestors(tree), most).collect()}
    assert got == {n: cluster(n) for n in kids if not kids[n]}
    assert max(sum(c == x for x in got.values()) for c in set(got.values())) <= most


def test_spanning_tree(spark):
    rnd = random.Random(5)
    edges = [(a, b, float(rnd.randint(1, 6))) for a, b in itertools.combinations(range(9), 2)]
    label, want = {n: n for n in range(9)}, []
    for d, a, b in sorted((d, a, b) for a, b, d in edges):
        if label[a] != label[b]:
            want.append((a, b, d))
            old, new = label[b], label[a]
            label = {n: new if x == old else x for n, x in label.items()}
    got = T.spanning_tree(spark.createDataFrame(edges, "a int, b int, distance double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_label_mismatch(spark):
    tree = spark.createDataFrame([("a",), ("b",), ("d",)], "label string")
    taxa = spark.createDataFrame([("a",), ("b",), ("c",)], "taxon string")
    assert sorted(map(tuple, T.label_mismatch(tree, taxa).collect())) == [("c", "missing"), ("d", "extra")]


@pytest.mark.parametrize("seed,most", [(4, 12.0), (6, 7.0)])
def test_diameter_clusters(spark, seed, most):
    rows, kids = grown(seed)
    tree = frame(spark, rows)
    length = {n: ln or 0.0 for n, _, ln, _ in rows}
    parent = {n: p for n, p, _, _ in rows}
    off = set()

    def far(n):
        own = sorted(((far(k), k) for k in kids[n]), key=lambda x: (-x[0], x[1]))
        while len(own) > 1 and own[0][0] + own[1][0] > most:
            off.add(own.pop(0)[1])
        return length[n] + (own[0][0] if own else 0.0)

    far(0)

    def cluster(n):
        return n if n in off or n == 0 else cluster(parent[n])

    closure = T.ancestors(tree)
    assert {r["leaf"]: r["cluster"] for r in T.diameter_clusters(tree, closure, most).collect()} == {n: cluster(n) for n in kids if not kids[n]}
    up = {n: [] for n in kids}
    for n in kids:
        at, dist = n, 0.0
        while at is not None:
            up[n].append((at, dist))
            dist, at = dist + length[at], parent[at]
    apart = max(d1 + d2 for a, b in itertools.combinations([n for n in kids if not kids[n]], 2) for x, d1 in up[a] for y, d2 in up[b] if x == y and not any(p == q for p, _ in up[a][: up[a].index((x, d1))] for q, _ in up[b][: up[b].index((y, d2))]))
    assert max(r["diameter"] for r in T.subtree_diameters(tree, closure).collect()) == apart


def test_polytomies(spark):
    rows = [(0, None, None, False), *[(k, 0, 1.0, k != 1) for k in range(1, 6)], *[(k, 1, 2.0, True) for k in range(10, 17)]]
    got = {r["node"]: (r["parent"], r["len"], r["is_leaf"]) for r in T.resolve_polytomies(frame(spark, rows)).collect()}
    kids = {}
    for n, (p, _, _) in got.items():
        kids.setdefault(p, []).append(n)
    assert len(kids[0]) == 3 and all(len(v) == 2 for p, v in kids.items() if p not in (None, 0))
    assert {n for n, (_, _, leaf) in got.items() if leaf} == {n for n, _, _, leaf in rows if leaf}

    def down(n):
        return {n} if got[n][2] else set().union(*(down(k) for k in kids[n]))

    assert down(1) == set(range(10, 17)) and sum(ln == 0.0 for _, ln, _ in got.values()) == len(got) - len(rows)


def test_newick_raises_on_deeper_nodes(spark):
    import pytest

    from strandweave.sources.trees import to_newick

    tree = spark.createDataFrame([(0, None, None, "r"), (1, 0, None, "a"), (2, 1, None, "b")], "node int, parent int, len double, label string")
    assert to_newick(tree, 2).first()["newick"] == "((b)a)r;"
    with pytest.raises(Exception, match="deeper than 1 levels"):
        to_newick(tree, 1).collect()

"""Log likelihoods against sums over all states of inner nodes."""

import itertools
import math
import random

import numpy as np
import pytest

from strandweave.operators import builders as B
from strandweave.operators import likelihood as L

#: ((0:0.1,1:0.3):0.2,2:0.5,(3:0.05,4:0.4):0.25)
NODES = [(0, 5, 0.1), (1, 5, 0.3), (2, 7, 0.5), (3, 6, 0.05), (4, 6, 0.4), (5, 7, 0.2), (6, 7, 0.25), (7, None, None)]


def by_hand(pattern):
    def change(a, b, t):
        return 0.25 + 0.75 * math.exp(-4 / 3 * t) if a == b else 0.25 - 0.25 * math.exp(-4 / 3 * t)

    total = 0.0
    free = [k for k, ch in enumerate(pattern) if ch not in "ACGT"]
    for inner in itertools.product("ACGT", repeat=3 + len(free)):
        state = dict(enumerate(pattern)) | dict(zip([5, 6, 7, *free], inner, strict=True))
        total += 0.25 * math.prod(change(state[p], state[n], t) for n, p, t in NODES if p is not None)
    return math.log(total)


def test_pruning_against_all_states():
    rnd = random.Random(2)
    some = ["".join(rnd.choice("ACGT-N") for _ in range(5)) for _ in range(25)] + ["AAAAA", "-----"]
    assert np.allclose(L.pruned(some, NODES), [by_hand(p) for p in some])
    assert L.pruned(["A"], [(0, None, None)]) == pytest.approx([math.log(0.25)])


def test_scores_of_alignments(spark):
    rnd = random.Random(3)
    cols = ["".join(rnd.choice("ACGT") for _ in range(5)) for _ in range(30)] * 3 + ["AAAAA"] * 40
    rows = [(1, f"t{k}", "".join(c[k] for c in cols)) for k in range(5)] + [(2, "x", "ACu"), (2, "y", None), (2, "z", "a"), (3, "no tree", "A")]
    aln = spark.createDataFrame(rows, "subset int, taxon string, seq string")
    assert {(r["subset"], r["pattern"]): r["n"] for r in L.patterns(aln.where("subset = 2").withColumnRenamed("taxon", "leaf")).collect()} == {(2, "A-A"): 1, (2, "C--"): 1, (2, "T--"): 1}
    nodes = [(1, n, p, x, f"t{n}" if n < 5 else None, n < 5) for n, p, x in NODES]
    nodes += [(2, k, 3, 0.1, name, True) for k, name in enumerate("xyz")] + [(2, 3, None, None, None, False)]
    trees = spark.createDataFrame(nodes, "subset int, node int, parent int, len double, label string, is_leaf boolean")
    got = {r["subset"]: r["score"] for r in L.log_likelihoods(aln, trees).collect()}
    assert got[1] == pytest.approx(sum(by_hand(c) for c in cols)) and set(got) == {1, 2} and got[2] < 0
    with pytest.raises(Exception, match="do not match"):
        L.log_likelihoods(aln.where("taxon <> 't3'"), trees).collect()


def test_corrected_distances_recover_lengths(spark):
    p = np.array([0.0, 0.1, 0.3, 0.74, 0.75, 1.0])
    got = B.corrected(p)
    assert np.allclose(got[:3], [0, 0.107326, 0.383119], atol=1e-5) and (np.diff(got) >= 0).all() and got.max() == B.MOST_CHANGES
    # on rows drawn from a tree, the tree that they came from is likelier than one with leaves exchanged
    rnd, rows = random.Random(1), {}
    for _ in range(400):
        state = {7: rnd.choice("ACGT")}
        for n, parent, t in [NODES[5], NODES[6], *NODES[:5]]:
            state[n] = state[parent] if rnd.random() < math.exp(-4 / 3 * t) else rnd.choice("ACGT")
        for k in range(5):
            rows[k] = rows.get(k, "") + state[k]
    aln = spark.createDataFrame([(0, f"t{k}", s) for k, s in rows.items()], "subset int, taxon string, seq string")
    tree = B.neighbour_joining(aln, correct=True)
    own = L.log_likelihoods(aln, tree).first()["score"]
    swap = spark.createDataFrame([("t0", "t3"), ("t3", "t0"), *[(f"t{k}", f"t{k}") for k in (1, 2, 4)]], "label string, other string")
    wrong = tree.join(swap, "label", "left").drop("label").withColumnRenamed("other", "label")
    assert own > L.log_likelihoods(aln, wrong).first()["score"] + 10
    assert own > L.log_likelihoods(aln, B.random_trees(aln.select("subset", "taxon"))).first()["score"]

"""What a worker has learnt about words: the same scores however it came by them, and no cost that grows with it."""

import time

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm import toxicity as X

WORDS = ["idiot", "plain", "trash", "a", "no", "idiots", "green", "i.d.i.o.t", "trashy", "river", "", "idixot", "ünlü", "stone"]


def marks():
    own = X.Landmarks(["^idiot$", "^trash$"])
    own.weigh(np.array([2.0, 1.0, -1.0]))
    return own


def texts(n):
    return [None if k % 17 == 0 else " ".join([WORDS[(k * j) % len(WORDS)] for j in range(k % 7)] + [f"w{k}x{j}" for j in range(k % 5)]) for k in range(n)]


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_margins_do_not_depend_on_what_was_seen_before(monkeypatch, most):
    rows = texts(120)
    want = np.vstack([marks().tops(pa.array([t], pa.string())) for t in rows])
    monkeypatch.setattr(X, "CHUNK_BYTES", 50)
    monkeypatch.setattr(X, "MOST_SEEN", most)
    own = marks()
    got = np.vstack([own.tops(pa.array(part, pa.string())) for part in (rows[:50], rows[50:], rows)])
    assert np.allclose(got, np.vstack([want, want]), atol=1e-6) and (want > -1).any()
    assert (own.seen[1:] > own.seen[:-1]).all()


def test_a_few_new_words_cost_little_beside_many_seen():
    own = marks()
    own.seen = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1_400_000).astype(np.uint64))
    took = []
    for k in range(5):
        start = time.process_time()
        own.tops(pa.array([f"alpha{k} beta{k} gamma{k}"], pa.string()))
        took.append(time.process_time() - start)
    # sorting or hashing all of them anew takes several times that
    assert min(took) < 0.4

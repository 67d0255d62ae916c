"""What a worker holds while it works out kernels does not grow with the words of a batch."""

import numpy as np

from strandweave.llm import toxicity as X


def test_kernels_are_worked_out_a_bounded_number_of_words_at_once(monkeypatch):
    marks, words = X.Landmarks(["^idiot$", "^trash$"]), [f"^idiot{k % 1000}$" for k in range(3 * 4096)]
    want, most, own = np.vstack([marks.values([w]) for w in words[:50]]), [], X._own
    monkeypatch.setattr(X, "_own", lambda symbols: most.append(len(symbols)) or own(symbols))
    got = marks.values(words)
    assert np.allclose(got[:50], want, atol=1e-6) and got.any(axis=1).sum() > 4096 and max(most) <= 4096

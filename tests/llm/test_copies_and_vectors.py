import hashlib
import math
import random

import numpy as np
import pytest

from strandweave.llm import clustering, tries, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# exact copies


def by_hand(rows):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t, *_ in rows:
        t = (t or "").translate(LOWER)
        ids = texts[t]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def copies(seed=3):
    rnd = random.Random(seed)
    stems = ["", "a", "ab", "abc", "Äa", "ÄA", "İx", "i̇x", "x" * 5_000, "x" * 5_000 + "y", "x" * 4_999 + "Y", "long " * 40_000]
    stems += ["".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 40))) for _ in range(150)]
    rows = []
    for k in range(600):
        t = rnd.choice(stems)
        rows.append((k * 7 - 1000, "".join(c.upper() if rnd.random() < 0.2 else c for c in t) if rnd.random() < 0.5 else t, "s"))
    rows += [(10_000 + k, "Hot text", "s") for k in range(700)]  # more than half of all rows
    return rows + [(5, None, "s"), (6, "", "s"), (None, "hot TEXT", "s"), (None, "without an id", "s"), (None, "Without an id", "s"), (7, "twice", "s"), (7, "twice", "s"), (-(2**63), "least id", "s"), (2**63 - 1, "LEAST id", "s")]


@pytest.mark.parametrize("most", [tries.MOST_BYTES, 20_000])
def test_copies_against_a_dictionary(docs, most):
    rows = copies()
    got = tries.deduplicate(docs(rows).repartition(5), most_bytes=most)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_smallest_id_kept_and_empty_tables(docs):
    rows = [(3, "a", "s"), (2, "A", "s"), (9, "b", "s")]
    assert {r["doc_id"]: r["keep_id"] for r in tries.deduplicate(docs(rows), keep="smallest").collect()} == {2: 2, 3: 2, 9: 9}
    assert tries.deduplicate(docs([])).collect() == []
    with pytest.raises(ValueError):
        tries.owners(docs(rows), keep="first")


def test_many_groups_meet_their_rows_without_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(tries, "HOT_ROWS", 50)
    rows = [(k, f"text {k % 40}" if k < 300 else "hot", "s") for k in range(700)]
    groups = tries.owners(docs(rows)).where("n > 1")
    digests = docs(rows).select("doc_id", "text").mapInArrow(tries._digests, "doc_id long, length long, sha binary")
    got = tries._told(digests, groups, groups.count(), most_small=0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_trie_holds_and_gives_back_all_texts():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30))).encode() for _ in range(2_000)]
    trie, want = tries.Trie(), {}
    for k, t in enumerate(texts):
        assert trie.insert(t, -k)
        want[t] = (-k, want.get(t, (0, 0))[1] + 1)
    assert {t: (r, n) for t, r, n in trie.terminals()} == want

    def weight(node):
        return len(node.label) + tries.NODE_BYTES + sum(weight(x) for x in (node.kids or {}).values())

    assert weight(trie.root) == trie.weight
    # what is forgotten and what is left are all of it, and what comes late is told apart
    gone = trie.spill(forget=False)
    assert gone and weight(trie.root) == trie.weight
    rest = list(trie.terminals())
    assert {t for t, _, _ in gone} | {t for t, _, _ in rest} == set(want) and len(gone) + len(rest) == len(want)
    assert not trie.insert(gone[0][0], 1) and trie.insert(rest[0][0], 1)
    while trie.spill(forget=True):
        assert weight(trie.root) == trie.weight
    assert len(list(trie.terminals())) == 1


def test_one_digest_for_different_texts_raises(monkeypatch):
    class Weak:
        def __init__(self, data):
            pass

        def digest(self):
            return b"same"

    monkeypatch.setattr(tries.hashlib, "sha256", Weak)
    assert list(tries._batches([(b"ab", 1, 1), (b"abc", 1, 1)], True))
    with pytest.raises(ValueError):
        list(tries._batches([(b"ab", 1, 1), (b"ba", 1, 1)], True))


# vectors


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, x string")


def odd(dims):
    nan = [0.5] * (dims - 1) + [math.nan]
    return [(901, None), (902, nan), (903, [math.inf] + [0.0] * (dims - 1)), (904, [None] + [1.0] * (dims - 1))]


def made(n, dims, seed=2):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(5, dims)) * 3
    return [(k * 3, (middles[k % 5] + draw.normal(size=dims)).astype(np.float32).tolist()) for k in range(n)]


def by_rounds(rows, k=8, rounds=10):
    xs = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    keyed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in xs if i is not None)
    cs = [v for _, v in keyed][:k]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        to = [near(v)[1] for _, v in xs]
        cs = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [v for (_, v), t in zip(xs, to, strict=True) if t == n]) else c for n, c in enumerate(cs)]
    last = [(i, *near(v)) for i, v in xs]
    sums = {n: sum(d for _, d, c in last if c == n) for n in range(len(cs))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted([(i, c, d, sums[c], sum(sums.values()), names[c]) for i, d, c in last], key=repr)


def test_clusters_against_plain_rounds(spark):
    rows = made(250, 64) + odd(64) + [(905, [1.0] * 63), (906, []), (None, [0.25] * 64), (0, made(1, 64)[0][1])]
    got = clustering.cluster(table(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_rounds(rows)
    few = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-2.0] * 64)]  # two centroids are equal: the smaller number takes all
    assert sorted((tuple(r) for r in clustering.cluster(table(spark, few)).collect()), key=repr) == by_rounds(few)
    assert clustering.cluster(table(spark, [])).collect() == [] == clustering.cluster(table(spark, odd(64))).collect()


def test_search_is_exact_and_passes_centroids_over():
    draw = np.random.default_rng(4)
    c = draw.integers(-4000, 4000, (40, 16))
    c[7], c[9] = c[3], c[3]
    x = np.vstack([c, c[3:4] + 1, draw.integers(-4000, 4000, (500, 16)), c[:30] + draw.integers(-50, 50, (30, 16))])
    search = clustering.Search(c)
    number, distance = search.nearest(x)
    every = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert search.tried < 0.9 * every.size
    far = np.full((1, 16), clustering.MOST)
    assert clustering.Search(-far).nearest(far)[1][0] == 16 * (2 * clustering.MOST) ** 2
    assert clustering._exact(np.full(9, 2**62)) == 9 * 2**62


def by_eigh(rows, k=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in kept}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in kept:
        off = np.array(v) - s / n
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        for j in range(min(k, fit.shape[1])):
            out.setdefault((i, j + 1), []).append((n, dev, off @ vectors[:, j] / np.sqrt(values[j]), values[j] / values.sum()))
    return out


def check_whitened(spark, rows):
    want, signs = by_eigh(rows), {}
    got = whitening.whiten(table(spark, rows).repartition(6)).collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, dev, white, share = next(x for x in want[r["vec_id"], r["component"]] if x[1] == r["deviation"])
        assert r["n"] == n and r["explained"] == pytest.approx(share, rel=1e-9) and r["identity_error"] < 1e-10
        sign = signs.setdefault(r["component"], np.sign(white * r["whitened"]))
        assert r["whitened"] * sign == pytest.approx(white, abs=1e-8)


def test_whitening_against_a_full_decomposition(spark):
    rows = made(400, 24)
    rows += [(9_000 + k, rows[3][1]) for k in range(300)] + [(3, rows[5][1]), (None, rows[6][1])] + odd(24) + [(906, [])]
    check_whitened(spark, rows)
    check_whitened(spark, [(k, [float(k), float(k * k), float(k * 7 % 5)]) for k in range(30)] + [(77, [0.0, 5.0, 0.0])])


def test_whitening_without_variance_and_of_nothing(spark):
    assert whitening.whiten(table(spark, [])).collect() == [] == whitening.whiten(table(spark, odd(3))).collect()
    same = whitening.whiten(table(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)] * 2
    line = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_updates_of_a_spectrum_with_equal_values():
    draw = np.random.default_rng(8)
    for x in (draw.integers(-3, 4, (60, 7)), np.repeat(np.eye(5, dtype=int), 9, axis=0), np.zeros((4, 3), int), draw.integers(-9, 9, (3, 12)), draw.normal(size=(90, 30)) * 10.0 ** -np.arange(30)):
        x = x.astype(float)
        parts = [whitening.Spectrum(x.shape[1]) for _ in range(3)]
        for k, row in enumerate(x):
            parts[k % 3].add(row)
        one = parts[0].join(parts[1]).join(whitening.Spectrum.of(parts[2].row()))
        c = x - x.mean(axis=0)
        scatter = c.T @ c
        assert one.n == len(x) and np.allclose(one.mean, x.mean(axis=0))
        assert np.abs(one.vectors.T @ one.vectors - np.eye(x.shape[1])).max() < 1e-12
        assert np.abs(one.vectors * one.values @ one.vectors.T - scatter).max() <= 1e-12 * max(1.0, np.abs(scatter).max())


def test_deviations_beyond_a_long_are_null():
    model = whitening.Whitening(10**6, [0, 5], np.eye(2), np.ones(2), 2.0)
    assert model.deviations(np.array([[1, 2], [10**9, 0]])) == [10**12 + (2 * 10**6 - 5) ** 2, None]

import random
import zlib

import numpy as np
import pyarrow as pa

from strandweave.llm import quality, toxicity

SYLLABLES = ["an", "er", "the", "on", "re", "ti", "sha", "lo", "mi", "ed", "and", "ou", "ble", "nd"]


def plain(rnd, n=60):
    return [("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3)))) + (rnd.random() < 0.15) * "." for _ in range(n)]


def labelled(spark, docs, make, column, folds):
    rnd = random.Random(11)
    rows, labels = [], []
    for k in range(500):
        y = int(rnd.random() < 0.3)
        rows.append((k, make(rnd, y), "s"))
        labels.append((k, y))
    frame = spark.createDataFrame([(k, y, y) for k, y in labels], "doc_id long, quality int, toxic int")
    return docs(rows + [(900, None, "s"), (901, "", "s"), (None, "x", "s"), (902, " ".join(["word"] * 30_000), "s")]), frame, dict(labels)


def insulting(rnd, y):
    words = plain(rnd)
    if y:
        words.insert(rnd.randrange(len(words)), rnd.choice(["grobian", "schuft", "halunke"]) + rnd.choice(["", "en", "isch"]))
    return " ".join(words)


def test_toxicity(spark, docs):
    df, labels, truth = labelled(spark, docs, insulting, "toxic", toxicity.FOLDS)
    model = toxicity.fit(df, labels)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 504 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) >= 0.97 * len(test)
    odd = model(pa.array(["such a gr.o-b*ian", "such a groxbian", "what a g r o b i a n he", "nothing of it", "schufterei", None, ""]))
    assert (odd[[0, 1, 2, 4]] >= 0.5).all() and (odd[[3, 5, 6]] < 0.5).all()


def test_rare_insults_beside_a_frequent_one(spark, docs):
    """Each insult with evidence of its own is learnt; the words of one document's copies are not."""
    rnd, rows = random.Random(5), []
    copied = " ".join([*plain(rnd, 80), "pfannkuchen"])
    for k in range(1_100):
        insult = "grobian" if k < 400 else "schuft" if k < 440 else None
        words = plain(rnd)
        if insult:
            words.insert(rnd.randrange(len(words)), insult)
        rows.append((k, f"{copied} nr{k}" if 440 <= k < 500 else " ".join(words), int(k < 500)))
    frame = spark.createDataFrame([(k, y, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs([(k, t, "s") for k, t, _ in rows]), frame)
    assert {"^grob", "^schu"} <= {z[:5] for z in model.words} and not any(z.startswith("^pfan") for z in model.words)
    alone = model(pa.array([" ".join([*plain(rnd, 20), w, *plain(rnd, 20)]) for w in ("grobian", "schuft", "pfannkuchen")]))
    assert (alone[:2] >= 0.5).all() and alone[2] < 0.5


def test_without_labels(spark, docs):
    df, labels, _ = labelled(spark, docs, insulting, "toxic", 5)
    none = labels.where("false")
    assert {r["predicted"] for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0}
    assert {r["predicted"] for r in quality.score(df, quality.fit(df, none)).collect()} == {1}
    empty = df.where("false")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []
    assert quality.score(empty, quality.fit(empty, labels)).collect() == []


def test_kernel_counts_gapped_subsequences():
    def by_hand(a, b):
        def features(w):
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i - 2)
            return out

        x, y = features(a), features(b)
        return sum(v * y.get(u, 0) for u, v in x.items())

    def value(a, b):
        found = (by_hand(a, b) / np.sqrt(by_hand(a, a) * by_hand(b, b))) ** toxicity.POWER
        return found if found >= toxicity.LEAST else 0.0

    marks = toxicity.Landmarks(["^grobian$", "^schuft", "^anananas$"])
    g = marks.kernel()
    assert np.allclose(np.diag(g), 1) and np.allclose(g, g.T) and np.allclose(marks.root @ g @ marks.root, np.eye(3), atol=1e-4)
    words = ["^grobian$", "^groxbian$", "^sschuffft$", "^schuf", "^plain$", "^ananas$", "^grob"]
    got = marks.values(words)
    assert np.allclose(got, [[value(w, z) for z in marks.words] for w in words], atol=1e-5) and got.any(axis=1).sum() >= 5
    # a text has the highest margins of its words, each the most of its portions and beginnings
    v = np.array([2.0, -0.5, 1.0, -1.0])
    marks.weigh(v)

    def margins(text):
        words = sorted({w for w in text.split() if len(w) >= 3})
        own = [max(float(v[:3] @ np.array(marks.features([p])[0], float)) + v[3] for p in toxicity._portions(w) + toxicity._shorter(w)) for w in words]
        return sorted([max(m, v[3]) for m in own] + [v[3]] * toxicity.TOP, reverse=True)[: toxicity.TOP]

    texts = ["a plain groxbian", "plain", "schuftig groxbian groxbian grobianen anananas", ""]
    assert np.allclose(marks.tops(pa.array([*texts, None])), [*[margins(t) for t in texts], [v[3]] * toxicity.TOP], atol=1e-5)
    model = toxicity.Model(marks.words, v, np.array([1.5, 0.5, 0.25, -0.3]))
    by_sum = [1 / (1 + np.exp(-(np.array(margins(t)) @ [1.5, 0.5, 0.25] - 0.3))) for t in texts]
    assert np.allclose(model(pa.array(texts)), by_sum, atol=1e-5)


def test_landmarks_are_spread():
    """The heaviest form comes first, what is nothing like it next, whatever stands between them in weight."""
    forms = [("^grobian$", 90.0), ("^grobian", 89.0), ("^grobi", 60.0), ("^schuft$", 5.0), ("^schuft", 50.0)]
    assert toxicity.spread(forms, most=2) == ["^grobian$", "^schuft"] and toxicity.spread([]) == []
    got = toxicity.spread(forms)
    assert got[0] == "^grobian$" and "^schuft" in got and "^grobian" not in got and "^schuft$" not in got


def test_the_curve_spares_label_0_but_not_forms_alone():
    tops = np.array([[3.0, 2.0, -1.0]] * 40 + [[-1.0, -1.0, -1.0]] * 400 + [[0.5, -1.0, -1.0]] * 10)
    y = np.array([1] * 40 + [0] * 410)
    v = toxicity.curve(tops, y, np.ones(450), np.array([[2.5, -1.0, -1.0]]))
    z = tops @ v[:-1] + v[-1]
    assert (v[:-1] >= 0).all() and (z[y > 0] > 0).all() and (z[y < 1] < 0).all() and v[0] * 2.5 - v[1] - v[2] + v[3] > 0


def test_every_insult_is_enough_alone(spark, docs):
    """Toxic texts that hold several insults each teach every one of them."""
    rnd, rows = random.Random(9), []
    insults = ["grobian", "schuft", "halunke", "lumpen", "trottel", "gauner"]
    for k in range(700):
        words = plain(rnd)
        if k < 200:
            for w in rnd.sample(insults, 3):
                words.insert(rnd.randrange(len(words)), w)
        rows.append((k, " ".join(words), int(k < 200)))
    frame = spark.createDataFrame([(k, y, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs([(k, t, "s") for k, t, _ in rows]), frame)

    def share(words):
        return (model(pa.array([" ".join([*plain(rnd, 20), w, *plain(rnd, 20)]) for w in words])) >= 0.5).mean()

    assert share(insults * 20) == 1.0
    assert share([f"{w[:k]}q{w[k:]}" for w in insults for k in range(2, len(w) - 1)]) >= 0.8
    assert share([rnd.choice(plain(rnd)) for _ in range(300)]) <= 0.01


def test_lookalikes():
    assert toxicity.lookalikes(["^grobianer$", "^plain$", "^grobian$"], ["^grobian$"], 2) == ["^grobian$", "^grobianer$"]
    assert toxicity.lookalikes([], ["^grobian$"]) == []


def test_repeated_rows_and_ids(spark, docs):
    df, labels, _ = labelled(spark, docs, insulting, "toxic", 5)
    twice = df.union(df.where("doc_id % 7 = 0")).union(docs([(7, "another text of that id", "s")]))
    for module in (toxicity, quality):
        model = module.fit(twice, labels)
        rows = module.score(twice, model).collect()
        assert len(rows) == twice.count()
        alike = {}
        for r in rows:
            alike.setdefault(r["doc_id"], set()).add(r["score"])
        assert all(len(v) == 1 for k, v in alike.items() if k != 7)
    again = toxicity.fit(twice.repartition(5), labels)
    assert again.words == toxicity.fit(twice, labels).words


def messy(rnd, y):
    words = plain(rnd)
    if not y:
        kind = rnd.randrange(3)
        words = [w + "###" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words[:12] for _ in range(9)]
    return " ".join(words)


def test_quality(spark, docs):
    df, labels, truth = labelled(spark, docs, messy, "quality", quality.FOLDS)
    rows = quality.score(df, quality.fit(df, labels)).collect()
    assert len(rows) == 504 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) >= 0.95 * len(test)


def test_quality_against_a_fit_over_rows(spark, docs):
    """Ridge on the rows of one hash, calibration on those of the other, both by hand."""
    df, labels, truth = labelled(spark, docs, messy, "quality", quality.FOLDS)
    model = quality.fit(df.repartition(5), labels)
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    used = [k for k in truth if zlib.crc32(str(k).encode()) % 4 != 2]
    dealt = {r["k"]: r["last"] for r in spark.createDataFrame([(k,) for k in used], "k long").selectExpr("k", "pmod(xxhash64(7, k), 4) = 0 AS last").collect()}
    x, y = quality.statistics(pa.array([text[k] for k in used])), np.array([truth[k] for k in used], float)
    last = np.array([dealt[k] for k in used])
    mean, spread = x[~last].mean(axis=0), np.sqrt(np.maximum(x[~last].var(axis=0), 1e-8))
    z = quality.fourier((x - mean) / spread)
    n = (~last).sum()
    weights = np.linalg.solve(z[~last].T @ z[~last] + quality.RIDGE * n * np.eye(z.shape[1]) / quality.FEATURES, z[~last].T @ y[~last])
    assert np.allclose(model.mean, mean) and np.allclose(model.raw(x), z @ weights, atol=1e-5)
    at = np.clip((z[last] @ weights - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = sorted(set(at.tolist()))
    shares, counts = [y[last][at == b].mean() for b in bins], [(at == b).sum() for b in bins]
    # the monotone fit as the largest of the least means
    fit = [max(min(np.average(shares[i : j + 1], weights=counts[i : j + 1]) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    assert np.allclose(model.levels, fit, atol=1e-6)


def test_sums_in_several_levels(spark, monkeypatch):
    monkeypatch.setattr(quality, "FAN_IN", 3)
    rows = spark.range(0, 100, 1, 20)
    assert quality._sum(rows, lambda batches: np.array([float(sum(sum(b.column(0).to_pylist()) for b in batches)), 1.0])).tolist() == [4950.0, 20.0]


def test_statistics_of_odd_texts():
    found = quality.statistics(pa.array([None, "", " \n ", "A b, A b, é 12!", "x"]))
    assert np.isfinite(found).all() and not found[:3].any() and found[3].any()


def test_monotone():
    got = quality.monotone(np.array([0.1, 0.5, 0.2, 0.9, 0.8]), np.array([1.0, 1, 1, 1, 3]))
    assert np.allclose(got, [0.1, 0.35, 0.35, 0.825, 0.825])

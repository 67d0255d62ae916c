import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm import fingerprints, hamming, jaccard, licenses, warc

WORDS = [f"w{k}" for k in range(400)]


def corpus(seed=5):
    """Texts with copies, near copies, a group around one text, and a passage that many share."""
    rnd = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        texts.append([rnd.choice(WORDS) for _ in range(rnd.randint(0, 120))] + (passage if rnd.random() < 0.6 else []))
    base = [rnd.choice(WORDS) for _ in range(150)]
    for _ in range(45):
        near = list(base)
        for _ in range(rnd.randint(0, 7)):
            near[rnd.randrange(len(near))] = f"e{rnd.randrange(10**6)}"
        texts.append(near)
    texts += [list(rnd.choice(texts)) for _ in range(25)]
    texts += [["One", "two"], ["one", "TWO"], ["x"], []]
    return [" ".join(t) for t in texts]


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def by_hand(rows):
    sets, label = {i: sets_of(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("often", [32, 6])
def test_near_duplicates_against_all_pairs(docs, monkeypatch, often):
    monkeypatch.setattr(jaccard, "FREQUENT", often)
    monkeypatch.setattr(jaccard, "WIDE_TILE", 8)
    rows = list(enumerate(corpus(), 100)) + [(1, None), (2, "  \n ")]
    got = jaccard.near_duplicates(docs([(i, t, "s") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_hand(rows)


def test_near_duplicates_of_odd_rows(docs):
    same = "a b c d e f g"
    got = jaccard.near_duplicates(docs([(5, same, "s"), (5, same, "s"), (None, same, "s"), (None, "other words stand in this one", "s"), (9, same.upper(), "s")])).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(repr, [(5, 3, 5), (5, 3, 5), (None, 3, 5), (None, 2, None), (9, 3, 5)]))
    assert jaccard.near_duplicates(docs([])).collect() == []


def test_bitmaps_bound_the_overlap():
    rnd = np.random.default_rng(1)
    for n in (3, 40, 500):
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rnd.integers(0, 2**63, n).astype(np.uint64)]))
        assert jaccard.overlap_bound(len(a), jaccard.bitmap(a), len(b), jaccard.bitmap(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    rnd = random.Random(4)
    links = [(a, a + 1) for a in range(40, 70)] + [(100, k) for k in range(101, 130)] + [(rnd.randrange(30), rnd.randrange(30)) for _ in range(20)]
    label = {n: n for e in links for n in e}
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: v for n, v in label.items() if any(n in e and e[0] != e[1] for e in links)}


def test_nearest_against_all_pairs(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(260, 64)).astype(np.float32)
    vectors[60:140] = vectors[50]  # one very common vector
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)] + [(None, vectors[0].tolist(), 1), (500, None, 1), (550, [], 1)]
    got = hamming.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance int")).collect()
    codes = {i: np.array(([x > 0 for x in v] + [False] * 64)[:64]) for i, v, _ in rows if i is not None and v is not None}
    want = set()
    for q in codes:
        if q % 50 == 0:
            near = sorted((int((codes[q] != c).sum()), i) for i, c in codes.items() if i != q)[:10]
            want |= {(q, i, d, k) for k, (d, i) in enumerate(near, 1)}
    assert {tuple(r) for r in got} == want
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming.nearest(none).collect() == []


def test_archives(spark, tmp_path):
    pages = [(k, f"http://www.host{k % 3}.example/p/{k % 7}?q={k}", "<html>é" + "x" * (k % 5 == 0 and 9 or k)) for k in range(60)]
    pages += [(100, None, None), (101, "http://[bad", ""), (None, "http://a.example/ü", "<p>none</p>"), (102, "http://a.example/\r\nx", "line\r\n\r\nWARC/1.1\r\n"), (103, "HTTP://A.example:80/ü#top", "<p>none</p>")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, archive string")
    got = warc.archive(df.repartition(4), str(tmp_path / "w")).collect()
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = set()
    for i, _, h in pages:
        body = (h or "").encode()
        first = i == last[h or ""]
        want.add((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""]))
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want and len(got) == len(pages)
    order = sorted(got, key=lambda r: (r["merge_range"], r["merge_position"]))
    keys = [(r["url_key"], r["captured_at"]) for r in order]
    assert keys == sorted(keys) and len({r["archive"] for r in got}) > 1
    assert warc.archive(df.where("false"), str(tmp_path / "e")).collect() == []


def test_loser_tree():
    rnd = random.Random(8)
    for n in (0, 1, 2, 3, 7, 12):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(9))) for _ in range(n)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_fingerprints(docs):
    rows = [(k * 3, t) for k, t in enumerate(corpus(6))] + [(1, None), (4, "ß𝄞é"), (None, "last of all"), (7, "same"), (7, "same")]
    got = fingerprints.fingerprint(docs([(i, t, "s") for i, t in rows])).collect()
    assert len(got) == len(rows)
    order = sorted(((i is None, i or 0, t or "") for i, t in rows))
    following = order[1:] + order[:1]
    want = sorted((i if not none else None, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[2][: len(t) // 2]).encode()).hexdigest()) for (none, i, t), n in zip(order, following, strict=True) if not none)
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == want
    text_of = {}
    for i, t in rows:
        text_of.setdefault(t or "", set()).add(i)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert all(len(set().union(*(by_id[i] for i in ids))) == 1 for ids in text_of.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert sum(r["near_edited"] for r in got) > sum(r["near_next"] for r in got)
    assert fingerprints.fingerprint(docs([])).collect() == []


def test_fingerprints_do_not_depend_on_ranges(docs, monkeypatch):
    df = docs([(k, t, "s") for k, t in enumerate(corpus(7))])
    one = sorted(map(tuple, fingerprints.fingerprint(df).collect()))
    monkeypatch.setattr(fingerprints, "PARTITION_BYTES", 2_000)
    assert sorted(map(tuple, fingerprints.fingerprint(df.repartition(5)).collect())) == one


def test_fingerprints_against_sets(docs):
    """Signatures agree exactly where the sets of terms do; likenesses are those of the sets."""
    rnd = random.Random(9)
    words = [f"t{k}" for k in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(120)] + ["Only once", "only ONCE", "b a", "a b", "", None, "x"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(docs([(i, t, "s") for i, t in rows])).collect()}
    sets = {i: set(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) for i, t in rows}
    df = {}
    for x in sets.values():
        for t in x:
            df[t] = df.get(t, 0) + 1
    low = max(2, int(np.ceil(fingerprints.LEAST_SHARE * len(rows))))
    band = {t for t, n in df.items() if low <= n <= max(low, fingerprints.MOST_SHARE * len(rows))}
    assert 10 < len(band) < len(df)

    def number(term):
        _, hashes, _ = next(fingerprints._terms(pa.array([term])))
        return hashes

    own = {t: [int(fingerprints.T.mix(number(t) ^ seed)[0]) for seed in fingerprints._SEEDS] for t in df}
    limits = [int(x) for x in fingerprints._LIMITS]
    subsets = {i: [x] + [{t for t in x & band if own[t][k] < limits[k]} for k in range(len(limits))] for i, x in sets.items()}
    pieces = {i: [r["fingerprint"][16 * k : 16 * k + 16] for k in range(len(limits) + 1)] for i, r in got.items()}
    for k in range(len(limits) + 1):
        by_set, by_sign = {}, {}
        for i in sets:
            by_set.setdefault(frozenset(subsets[i][k]), set()).add(pieces[i][k])
            by_sign.setdefault(pieces[i][k], set()).add(frozenset(subsets[i][k]))
        assert all(len(v) == 1 for v in by_set.values()) and all(len(v) == 1 for v in by_sign.values())
    for i, _ in rows:
        a, b = subsets[i], subsets[(i + 1) % len(rows)]
        either = sum(bool(x or y) for x, y in zip(a[1:], b[1:], strict=True))
        want = 1.0 if a[0] == b[0] else sum(bool(x) and x == y for x, y in zip(a[1:], b[1:], strict=True)) / max(1, either)
        assert abs(got[i]["near_next"] - want) < 1e-9
    assert got[120]["near_next"] == 1.0 and got[123]["near_next"] == 0.0  # the same terms; no terms beside some


def test_short_texts_are_told_apart(docs):
    rnd = random.Random(2)
    rows = [(k, " ".join(f"r{rnd.randrange(10**9)}" for _ in range(1 + k % 10)), "s") for k in range(300)]
    got = fingerprints.fingerprint(docs([*rows, (999, "long " * 60_000, "s")])).collect()
    assert len({r["fingerprint"] for r in got}) == 301 and max(r["near_next"] for r in got) == 0.0


def test_members_are_read_by_their_place(spark, tmp_path):
    import gzip

    pages = [(k, f"http://h{k % 4}.example/{k}", f"<p>{k}</p>" * (k % 50)) for k in range(400)] + [(5, "http://h1.example/5", "again"), (1000, "http://long.example/", "y" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6)
    folder = str(tmp_path / "w")
    got = warc.archive(df, folder).collect()
    assert len(got) == len(pages)
    for r in got[::25]:
        with open(f"{folder}/{r['archive']}", "rb") as f:
            f.seek(r["offset"])
            headers, payload = warc.parsed(gzip.decompress(f.read(r["length"])))
        assert headers["WARC-Payload-Digest"] == f"sha1:{r['payload_digest']}" and len(payload) in (0, r["payload_bytes"])
    with open(f"{folder}/{got[0]['archive']}", "rb") as f:
        data = f.read()
    assert gzip.decompress(data) == b"".join(x for _, _, x in warc.members(data))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(data[:-40]))
    order = sorted(got, key=lambda r: (r["merge_range"], r["merge_position"]))
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in order]
    assert keys == sorted(keys)


def test_merging_in_levels(monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 3)
    rnd = random.Random(8)
    runs = [sorted(rnd.randrange(99) for _ in range(rnd.randrange(9))) for _ in range(40)]
    assert list(warc.merged([iter(r) for r in runs])) == sorted(x for r in runs for x in r) and list(warc.merged([])) == []


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, -1.0], 1), (0, [-1.0, -1.0], 1), (3, [1.0, 1.0], 1), (50, [1.0, 1.0], 1)]
    got = hamming.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect()
    assert sorted((r["query_id"], r["neighbor_id"], r["distance"], r["rank"]) for r in got) == [(0, 3, 2, 1), (0, 50, 2, 2), (50, 0, 2, 2), (50, 3, 0, 1)]


def test_long_near_copies(docs):
    long = [f"w{k % 977}x{k % 31}" for k in range(60_000)]
    near = list(long)
    near[::500] = ["other"] * len(near[::500])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs([(1, " ".join(long), "s"), (2, " ".join(near), "s"), (3, " ".join(long[:30_000]), "s")])).collect()}
    assert got == {i: c for i, (_, c) in by_hand([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:30_000]))]).items()}


def test_scans_of_odd_tables(docs):
    rows = [(1, "MIT License\n", "s"), (1, "MIT License\n", "s"), (None, "cc by", "s"), (None, None, "s")]
    got = [(r["doc_id"], r["base_labels"]) for r in licenses.scan(docs(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, "mit"), (1, "mit"), (None, "cc-by"), (None, "")]))
    assert licenses.scan(docs([])).collect() == []
    (r,) = licenses.scan(docs([(1, "é SPDX-License-Identifier no colon. SPDX license identifier : ISC and (MIT)\n spdx-license-identifier: (GPL) WITH x", "s")])).collect()
    assert r["expressions"] == ["isc mit and"] and r["permissive"]


def test_license_scan(docs):
    texts = {
        1: "Licensed under the MIT License, or the Apache-License. gnu GENERAL public license",
        2: "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 -->",
        3: "cc by-nc 4.0 ccby CC BY cc_by",
        4: None,
        5: "SPDX-License-Identifier: OR nothing. All rights reserved",
        6: "émit license mit  license" + " z" * 5000,
    }
    got = {r["doc_id"]: r for r in licenses.scan(docs([(i, t, "s") for i, t in texts.items()])).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(got[i]["base_labels"].split(",")) <= set(got[i]["labels"].split(",")) or not places
    assert got[2]["expressions"] == ["mit apache-2.0 or gpl-2.0-only classpath-exception-2.0 with and"]
    assert got[2]["labels"] == "apache-2.0,gpl-2.0-only with classpath-exception-2.0,mit" and got[2]["permissive"] is False and got[2]["score"] == 1.0
    assert got[5]["labels"] == "all-rights-reserved" and got[4]["score"] == 0.0


@pytest.mark.parametrize("text,postfix,names,allowed", [
    ("MIT", ["mit"], {"mit"}, True),
    ("GPL-2.0 OR MIT AND ISC", ["gpl-2.0", "mit", "isc", "and", "or"], {"gpl-2.0", "mit", "isc"}, True),
    ("(GPL-2.0 OR MIT) AND GPL-3.0", ["gpl-2.0", "mit", "or", "gpl-3.0", "and"], {"gpl-2.0", "mit", "gpl-3.0"}, False),
    ("MIT */", ["mit"], {"mit"}, True),
])
def test_expressions(text, postfix, names, allowed):
    assert licenses.parse(text) == postfix
    assert licenses.evaluate(postfix) == (names, allowed)


@pytest.mark.parametrize("text", ["", "AND MIT", "(MIT", "MIT OR", "()", "(MIT OR ISC) WITH e", "MIT WITH e WITH f", "MIT WITH (e)", "MIT WITH"])
def test_no_expressions(text):
    assert licenses.parse(text) is None

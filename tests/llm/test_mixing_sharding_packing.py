import heapq
import random
import zlib

import numpy as np

from strandweave.llm import mixing, packing, sharding

_RND = random.Random(7)
SAMPLES = [(k, " ".join(["word"] * _RND.randint(0, 60)), s) for k, s in enumerate(s for s in ("b", "a", None, "c") for _ in range(60))]
ODD = [(900, None, "a"), (901, "", "b"), (902, "  \t ", None), (None, "no id here", "c"), (903, "twice", "a"), (903, "twice", "a"), (904, "x" * 50_000 + " y", "b")]


def shares(sizes):
    """Targets by weight 1, 2, 3, cut at three times the size; the excess goes to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(docs):
    df = docs(SAMPLES + ODD)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(SAMPLES) + len(ODD)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = shares(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 5 for s in want)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    size = {r["doc_id"]: r["size"] for r in rows}
    assert size[900] == size[901] == size[902] == 0 and size[None] == 3 and size[904] == 2


def test_mix_keeps_columns_and_repeats(docs):
    df = docs(SAMPLES)
    kept = mixing.mix(df, keep=True)
    assert kept.columns == df.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    n = {}
    for r in kept.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n == {k: c for k, c in copies.items() if c}


def test_one_and_no_source(docs):
    assert {r["taken"] for r in mixing.mix(docs([(1, "a b", "s"), (2, "c d", "s")])).collect()} == {2}
    assert mixing.mix(docs([])).collect() == []
    assert {r["target"] for r in mixing.mix(docs([(1, None, "s")])).collect()} == {0.0}


def test_shards_are_even_and_whole(docs):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    rows = [(k, rnd.choice(texts), "s") for k in range(900)] + ODD
    got = sharding.shard(docs(rows)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    of, load, slots = {}, {}, {}
    for r in got:
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = [v for s, v in load.items() if v < 50_000]
    assert len(load) == 16 and max(rest) - min(rest) < 0.05 * max(rest)
    crc = {i: zlib.crc32((t or "").encode()) for i, t, _ in rows}
    assert all(r["text_crc32"] == crc[r["doc_id"]] for r in got)
    assert sharding.shard(docs([])).collect() == []


def test_schedule_is_largest_first():
    rnd = random.Random(1)
    units = [(rnd.randint(1, 99), f"u{k}") for k in range(50)]
    got, loads = sharding.schedule(units, 4), [0] * 4
    for size, name in sorted(units, key=lambda u: (-u[0], u[1])):
        k = min(range(4), key=lambda k: (loads[k], k))
        assert got[name] == k
        loads[k] += size


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rows = [(k, " ".join(f"word{j}, Ünïcode {j}." for j in range(k * 13 % 700)), "s") for k in range(40)] + ODD + [(950, "<|endoftext|> it's ŉ İ", "s")]
    got = packing.pack(docs(rows)).collect()
    ids = {}
    for i, t, _ in rows:
        ids[i] = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    total = {}
    for r in got:
        own = ids[r["doc_id"]]
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own)
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(x) * (2 if i == 903 else 1) for i, x in ids.items()}
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.SIZE
    assert packing.pack(docs([])).collect() == []


def test_plan_places_every_length():
    rnd = random.Random(2)
    histogram = {x: rnd.randint(1, 40) for x in rnd.sample(range(1, 2049), 300)}
    plan = packing.plan(histogram)
    placed = {}
    for lengths, n in plan:
        assert sum(lengths) <= 2048 and list(lengths) == sorted(lengths, reverse=True)
        for x in lengths:
            placed[x] = placed.get(x, 0) + n
    assert placed == histogram
    # the same by one pack at a time
    heap, packs = [], []
    for x in sorted(histogram, reverse=True):
        for _ in range(histogram[x]):
            if heap and heap[0][0] + x <= 2048:
                used, k = heapq.heappop(heap)
            else:
                used, k = 0, len(packs)
                packs.append([])
            packs[k].append(x)
            heapq.heappush(heap, (used + x, k))
    assert abs(sum(n for _, n in plan) - len(packs)) <= 0.01 * len(packs) + 1

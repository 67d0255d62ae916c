"""Near-duplicate documents: exact n-gram Jaccard links and their components.

A tile holds documents of one band of set sizes, and of the band below, that agree in a signature: sets
that link are of one band or of two neighbouring ones. In a tile, hashed bitmaps bound the overlap
from above and the pairs that remain are settled by exact intersection of the sorted shingle arrays.

How a pair comes into a tile. Shingles that many documents carry (a passage, a common first line,
what a large group of near copies shares) are told apart from the others by counting within blocks
of documents. Let a pair link and h be the frequent share of its union.

- h <= 0.3: each set has SIGNATURES min-wise hashes of its infrequent part; those parts have
  similarity (0.75 - h) / (1 - h) >= 0.64, so the pair misses all 20 with probability
  0.36^20 < 2e-9. A tile that is wide all the same is split by its members' other signatures.
  A pair that shares just one signature, and that in a wide tile, is missed by the split: at most
  20 x 0.64 x 0.36^19 < 5e-8 more of the pairs.
- h > 0.3: both sets are frequent to more than 0.3. Each of these has its elements in one global
  order, infrequent first, then by count; a linked pair's first common element stands so early in
  both that the elements behind it can still make up the overlap. Such prefixes are joined with
  that test of places, which misses nothing.

What counts as frequent decides only how much work there is; no tile is dropped or capped.

Copies are never expanded into pairs. Equal sets are one node. Then, in a few rounds, the members
of each tile are held against HUBS of them only, those made of frequent shingles the most, as the
text is that a group's copies stem from; what links is contracted, and later tiles pair members of different components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut, lean, settled, small

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
SIGNATURES, HUB_SIGNATURES, HUBS, HUB_ROUNDS = 20, 6, 4, 2
#: A shingle is frequent from so many occurrences on, if some block has BLOCK_LEAST of them.
FREQUENT, BLOCK_LEAST, BLOCK_SHINGLES, BLOCK_DOCS = 32, 3, 2_000_000, 4_000
#: The frequent shingles that tasks are given: 8 bytes each; beyond it the least frequent count as others.
MOST_FREQUENT = 2_000_000
FREQUENT_PART = 0.3
#: Members of a tile beyond which it is split by a second signature.
WIDE_TILE = 48
#: Bands of sizes: a little wider than the 4 / 3 by which the sizes of linked sets differ at most.
BAND = 1.34
#: Words of a bitmap for a set of n shingles: two bits a shingle, a power of two, in this range.
LEAST_BITS, MOST_BITS = 64, 1 << 15

_U = np.uint64
_SEEDS = T.mix(np.arange(1, SIGNATURES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))[:, None]
_FACTORS = T.mix(_SEEDS) | _U(1)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for lo, hi, data, offsets in T.chunks(column):
        low = T.LOWER[data]
        starts, ends = T.spans(~T.SEPARATOR[low], offsets)
        hashes, borders = T.shingles(T.span_hashes(low, starts, ends), T.rows_of(starts, offsets), width)
        for row in range(hi - lo):
            yield lo + row, np.unique(hashes[borders[row] : borders[row + 1]])


def _bits(n: int) -> int:
    return int(min(MOST_BITS, max(LEAST_BITS, 1 << (2 * n - 1).bit_length()))) if n else LEAST_BITS


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit for each hash, of as many as the size band asks for."""
    width = _bits(len(hashes))
    flags = np.zeros(width, np.uint8)
    flags[(hashes >> _U(7)) & _U(width - 1)] = 1
    return np.packbits(flags, bitorder="little")


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x


def overlap_bound(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray) -> int:
    """No fewer than the elements that both sets hold.

    A bit that only one side sets stands for at least one element that the other lacks.
    """
    size = min(len(a), len(b))
    a, b = _folded(a, size), _folded(b, size)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def frequent_shingles(docs: DataFrame, text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that occur often in all documents, no more than MOST_FREQUENT, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def told() -> pa.RecordBatch:
            every = np.sort(np.concatenate(waiting)) if waiting else np.zeros(0, _U)
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(every)))
            return pa.RecordBatch.from_arrays([pa.array(every[first[n >= BLOCK_LEAST]].view(np.int64)), pa.array(n[n >= BLOCK_LEAST])], ["shingle", "n"])

        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(0)):
                low = T.LOWER[data]
                starts, ends = T.spans(~T.SEPARATOR[low], offsets)
                hashes, _ = T.shingles(T.span_hashes(low, starts, ends), T.rows_of(starts, offsets), width)
                waiting.append(hashes)
                size += len(hashes)
                if size >= BLOCK_SHINGLES:
                    yield told()
                    waiting, size = [], 0
        yield told()

    rows = docs.select(F.col(text).alias("text"))
    # a block of few documents would see little
    counts = rows.coalesce(max(1, rows.count() // BLOCK_DOCS)).mapInArrow(lean(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = cut(counts.where(F.col("n") >= FREQUENT))
    # the least count that keeps to the bound, by classes of counts
    of_class = F.floor(8 * F.log2("n")).cast("int")
    least, room = None, MOST_FREQUENT
    for r in often.groupBy(of_class.alias("k")).agg(F.count("*").alias("shingles")).orderBy(F.desc("k")).collect():
        if (room := room - r["shingles"]) < 0:
            break
        least = r["k"]
    found = often.where(of_class >= least if least is not None else F.lit(False)).toPandas()
    shingle, n = found["shingle"].to_numpy(np.int64).view(_U), found["n"].to_numpy(np.int64)
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _least(hashes: np.ndarray) -> np.ndarray:
    """For each signature, the hash that comes first in its order."""
    return hashes[((hashes ^ _SEEDS) * _FACTORS).argmin(axis=1)]


def _overlap(n_a, n_b):
    """The least intersection with which sizes ``n_a`` and ``n_b`` link, as a Column or a number."""
    total = NUMERATOR * (n_a + n_b)
    return F.ceil(total / (NUMERATOR + DENOMINATOR)) if not isinstance(total, int) else -(-total // (NUMERATOR + DENOMINATOR))


def signatures(docs: DataFrame, doc_id: str, text: str, often: Broadcast, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_key, mins, whole, heads, bits, core) for each row.

    ``often``: what ``frequent_shingles`` gives. ``mins``: SIGNATURES of the infrequent part, none if it is empty; an entry's place is part of
    its value. Sets of which much is frequent have HUB_SIGNATURES of the ``whole`` and ``heads``,
    the first elements in the global order, as many as a link can leave unmatched and one more. ``core``: the frequent share.
    """
    schema = "doc_id long, n_shingles long, set_key binary, mins array<long>, whole array<long>, heads array<long>, bits binary, core double"
    types = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_n = often.value
        kinds = T.mix(np.arange(2 * SIGNATURES, dtype=_U) + _U(77))
        none = np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for _, h in _sets(batch.column(1), width):
                if not len(h):
                    out.append((0, None, none, none, none, None, 0.0))
                    continue
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1) if len(hot) else none
                frequent = hot[at] == h if len(hot) else np.zeros(len(h), bool)
                rare = h[~frequent]
                mins = T.mix(_least(rare) ^ kinds[:SIGNATURES]).view(np.int64) if len(rare) else none
                whole = heads = none
                if len(h) - len(rare) > FREQUENT_PART * len(h):
                    whole = T.mix(_least(h) ^ kinds[SIGNATURES:])[:HUB_SIGNATURES].view(np.int64)
                    shared = h[frequent][np.lexsort((h[frequent], hot_n[at[frequent]]))]
                    least = -(-NUMERATOR * len(h) // DENOMINATOR)
                    heads = np.concatenate([rare, shared])[: len(h) - least + 1].view(np.int64)
                key = np.array([np.bitwise_xor.reduce(h), np.add.reduce(T.mix(h))], _U).tobytes() + len(h).to_bytes(4, "little")
                out.append((len(h), key, mins, whole, heads, bitmap(h).tobytes(), 1 - len(rare) / len(h)))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], [f.split()[0] for f in schema.split(", ")])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(scan), schema)


def _pairs_that_may_link(pairs: DataFrame, n_pairs: int, nodes: DataFrame) -> DataFrame:
    """Keeps (a, b) whose bitmaps do not rule out the link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            keep = [DENOMINATOR * o >= NUMERATOR * (m + n - o) for m, n, p, q in zip(x["n_a"], x["n_b"], x["bits_a"], x["bits_b"], strict=True) for o in [overlap_bound(m, np.frombuffer(p, np.uint8), n, np.frombuffer(q, np.uint8))]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    like = a.join(small(pairs, n_pairs), "a").join(b, "b").where(DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b"))
    return like.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(lean(bound), "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, width: int, per_hub: int = 256) -> DataFrame:
    """The (a, b) whose sets link, by exact intersection.

    The texts of a hub ``a`` and of its partners meet in one place, in portions of ``per_hub``
    partners, so that a hub of many partners is spread.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("__n"))
    portion = F.pmod(F.xxhash64("b"), F.ceil(F.col("__n") / per_hub)).cast("int").alias("part")
    dealt = pairs.join(sizes, "a").select("a", "b", portion)
    ends = F.explode(F.array(F.struct(F.col("b").alias("doc_id"), F.lit(1).alias("role")), F.struct(F.col("a").alias("doc_id"), F.lit(0).alias("role")))).alias("end")
    wanted, n_wanted = settled(dealt.select("a", "part", ends).select("a", "part", "end.*").distinct())
    # the texts that are wanted: beside a side that is counted and small, else by a shuffle
    found = texts.join(small(wanted, n_wanted), "doc_id").select("a", "part", "role", "doc_id", "text")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for batch in batches:
            a, part, role, doc = (batch.column(k).to_pylist() for k in range(4))
            found_a, found_b = [], []
            for row, h in _sets(batch.column(4), width):
                if (a[row], part[row]) != at:
                    at, hubs = (a[row], part[row]), []
                if role[row] == 0:
                    hubs.append(h)
                elif len(h) and any(_linked(hub, h) for hub in hubs if len(hub)):
                    found_a.append(a[row])
                    found_b.append(doc[row])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    met = found.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return met.mapInArrow(lean(settle), "a long, b long")


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, label) for the nodes that links touch: label is the smallest node reachable.

    Alternates large-star and small-star steps until a round changes nothing.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Points the neighbours of each node, the larger ones or all, at the least of them."""
        both = edges.union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        dealt = both.repartition("u")
        met = dealt.join(dealt.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")
        if large:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    edges, _ = settled(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"))
    mark = None
    for _ in range(most_rounds):
        edges, n = settled(star(star(edges, True), False))
        now = (n, edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0])
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links did not contract in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _labelled(nodes: DataFrame, labels: tuple[DataFrame, int] | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.drop("label").join(small(*labels), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _band(n: str = "n") -> Column:
    return F.floor(F.log(n) / float(np.log(BAND))).cast("int")


def _banded(keys: DataFrame) -> DataFrame:
    """Rows with a signature ``sig`` under the ``key`` of its tile, of their own band and of the next one up."""
    tiles = F.explode(F.array(F.struct(_band().alias("band"), F.lit(True).alias("own")), F.struct((_band() + 1).alias("band"), F.lit(False).alias("own")))).alias("tile")
    return keys.select("*", tiles).withColumn("key", F.xxhash64("sig", "tile.band")).withColumn("own", F.col("tile.own")).drop("tile")


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, node, label, ...) whose key more than one component has, with the key's rows ``c``.

    Keys are counted first, within tasks before the shuffle; the rows then meet the few that are
    shared, beside a small side or in a join whose large keys Spark can split.
    """
    tiles = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), *([F.max("own").alias("held")] if "own" in keys.columns else []))
    tiles, n = settled(tiles.where("lo < hi and held" if "own" in keys.columns else "lo < hi").select("key", "c"))
    return keys.join(small(tiles, n), "key")


def _hub_pairs(keys: DataFrame, turn: int) -> DataFrame:
    """(hub, member) of each tile; the hubs are the foremost of HUBS random parts of it."""
    met, _ = settled(_shared(_banded(keys)).select("key", "node", "label", "core"))
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(HUBS)).alias("part")
    hubs = met.groupBy("key", part).agg(F.min(F.struct(-F.col("core"), F.col("node"), F.col("label"))).alias("hub"))
    pairs = met.join(hubs.select("key", "hub"), "key").where("label <> hub.label")
    return pairs.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()


def _tile_pairs(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different components that share a tile, and that sizes allow to link."""
    met, _ = settled(_shared(_banded(keys)).select("key", "sig", "c", F.struct("node", "label", "n", "own").alias("x")))
    narrow = met.where(F.col("c") <= WIDE_TILE).select("key", "x")
    # a wide tile: its members meet again where they share one more signature
    wide = met.where(F.col("c") > WIDE_TILE).select("key", "sig", "x", F.col("x.node").alias("node"))
    second = wide.join(nodes.select("node", "mins"), "node").select("key", "sig", "x", F.explode("mins").alias("other")).where("other <> sig")
    split = _shared(second.select(F.xxhash64("key", "other").alias("key"), "x.node", "x.label", "x.n", "x.own"))
    split = split.select("key", F.struct("node", "label", "n", "own").alias("x"))

    def met_in(tiles: DataFrame) -> DataFrame:
        pairs = tiles.alias("p").join(tiles.alias("q"), "key")
        near = (F.col("p.x.node") < F.col("q.x.node")) & (F.col("p.x.label") != F.col("q.x.label")) & (F.col("p.x.own") | F.col("q.x.own"))
        banded = DENOMINATOR * F.least("p.x.n", "q.x.n") >= NUMERATOR * F.greatest("p.x.n", "q.x.n")
        return pairs.where(near & banded).select(F.col("p.x.node").alias("a"), F.col("q.x.node").alias("b"))

    return met_in(narrow).union(met_in(split))


def _prefix_pairs(heads: DataFrame) -> DataFrame:
    """Pairs of different components whose prefixes meet early enough, from (key, node, label, n, place).

    Of a pair the larger set probes with its prefix for any size, the smaller one is found by the
    shorter prefix that partners no smaller than itself leave. Tiles are of an element and a band:
    the larger set probes those of its own band and of the one below.
    """
    met = _shared(heads).select("key", _band().alias("band"), F.struct("n", "node", "label", "place").alias("x"))
    probe = met.select("key", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "x").alias("p")
    found = met.where(F.col("x.place") <= F.col("x.n") - _overlap(F.col("x.n"), F.col("x.n"))).alias("q")
    p, q = F.col("p.x"), F.col("q.x")
    order = (q["n"] < p["n"]) | ((q["n"] == p["n"]) & (q["node"] < p["node"]))
    banded = DENOMINATOR * q["n"] >= NUMERATOR * p["n"]
    least = _overlap(p["n"], q["n"])
    early = (p["n"] - p["place"] >= least) & (q["n"] - q["place"] >= least)
    same = (F.col("p.key") == F.col("q.key")) & (F.col("p.band") == F.col("q.band")) & (p["label"] != q["label"])
    return probe.join(found, same & order & banded & early).select(q["node"].alias("a"), p["node"].alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, settled_links
    (links of its set to others that were settled; contraction makes most of a group's needless).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; sets hold distinct runs of ``width``
    words, or the whole sequence if it is shorter. Sets link when 100 * intersection >= 75 * union.
    Null, empty and word-less texts have n_shingles 0, link with nothing and are their own
    component. Rows with a null id keep component_id null unless an equal set has an id; they carry
    no link of their own. Rows that repeat an id count as one document: it has the links of each of
    its texts. Other columns are ignored.
    """
    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, width))
    rows, _ = settled(signatures(docs, doc_id, text, often, width), 4_000)
    often.destroy()
    sets = rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("mins", "whole", "heads", "bits", "core")])
    sets, _ = settled(sets, 4_000)
    nodes = sets.drop("set_key")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def tried(pairs: DataFrame) -> tuple[DataFrame, int]:
        likely, _ = settled(_pairs_that_may_link(*settled(pairs), nodes))
        return settled(_links(likely, texts, width))

    labels, found = None, None
    for turn in range(HUB_ROUNDS):
        some = _labelled(nodes, labels).select("node", "label", "n", "core", F.explode(F.concat(F.slice("mins", 1, HUB_SIGNATURES), "whole")).alias("sig"))
        new, n_new = tried(_hub_pairs(some, turn))
        if not n_new:
            break
        found = new if found is None else found.union(new)
        labels = settled(components(found))
    now = _labelled(nodes.select("node", "n", "mins", "heads"), labels)
    by_signature = _tile_pairs(now.select("node", "label", "n", F.explode("mins").alias("sig")), nodes)
    by_prefix = _prefix_pairs(now.select("node", "label", "n", F.posexplode("heads").alias("place", "key")))
    last, n_last = tried(by_signature.union(by_prefix).distinct())
    if n_last:
        found = last if found is None else found.union(last)
        labels = settled(components(found))

    # sets to their nodes' components, then rows to their sets; both sides are narrow
    of_node = _labelled(sets.select("set_key", "node"), labels).select("set_key", F.col("label").alias("component"))
    if found is not None:
        ends = found.select(F.col("a").alias("node"), F.col("b").alias("other")).union(found.select("b", "a")).distinct()
        degree = ends.groupBy("node").agg(F.count("*").alias("links"))
        of_node = _labelled(sets.select("set_key", "node"), labels).join(degree, "node", "left").select("set_key", F.col("label").alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("settled_links"))
    else:
        of_node = of_node.withColumn("settled_links", F.lit(0).cast("long"))
    linked = rows.select("doc_id", "n_shingles", "set_key").join(of_node, "set_key", "left")
    return linked.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("settled_links", F.lit(0)).cast("long").alias("settled_links"))

"""Exact copies of whole texts, found by owners in Patricia tries.

Texts are compared as UTF-8 bytes after A-Z are lower-cased. Each task first puts its own rows into a
trie, so that a text leaves a task once however many copies it has there; a trie that grows too large
hands on the texts of its heaviest subtree and forgets them. Texts are then dealt to partitions by
length and content hash, whose tries hold full byte strings: a terminal node keeps the smallest
identifier and the number of rows. There a subtree that does not fit is set aside with all that still
comes under its prefix and dealt anew over more partitions, until nothing is left; each round
finishes at least one text of every partition.

Null texts are empty. Null ids are members of their group but own it only where no row has an id;
rows that repeat both id and text are kept or dropped together. An empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Batches, cut, lean, settled, small

#: Bytes that a task's trie may take, nodes included, before its heaviest subtree goes.
MOST_BYTES = 64 << 20
#: What a node costs beside its label.
NODE_BYTES = 400
#: Groups of at least this many rows, or of this share of all rows, meet their rows by broadcast.
HOT_ROWS, HOT_SHARE = 1_000, 100_000
OUT_BYTES = 4 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROW = "length long, sha binary, text binary, rank long, n long, done boolean"


class Node:
    """An edge's label and what is below it. ``n`` is 0 unless a text ends here."""

    __slots__ = ("label", "kids", "n", "rank", "weight", "away")

    def __init__(self, label: bytes, n: int = 0, rank: int | None = None):
        self.label, self.kids, self.n, self.rank, self.away = label, None, n, rank, False
        self.weight = len(label) + NODE_BYTES


def _common(a: bytes, b: bytes, start: int) -> int:
    """How many bytes ``a`` shares with ``b[start:]``; halves, as slices are compared at once."""
    lo, hi = 0, min(len(a), len(b) - start)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[start + lo : start + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Trie:
    """A radix trie over byte strings without unary inner nodes, but the root and where a text ends."""

    def __init__(self):
        self.root = Node(b"")

    @property
    def weight(self) -> int:
        return self.root.weight

    def insert(self, text: bytes, rank: int | None, n: int = 1) -> bool:
        """Adds ``n`` rows of a text; False where its subtree has been set aside."""
        node, at, path = self.root, 0, [self.root]
        while True:
            if node.away:
                return False
            if at == len(text):
                node.rank = _smaller(node.rank, rank) if node.n else rank
                node.n += n
                return True
            kid = node.kids.get(text[at]) if node.kids else None
            if kid is None:
                new = Node(text[at:], n, rank)
                node.kids = node.kids or {}
                node.kids[text[at]] = new
                for x in path:
                    x.weight += new.weight
                return True
            if not text.startswith(kid.label, at):
                k = _common(kid.label, text, at)
                fork = Node(kid.label[:k])
                fork.kids = {kid.label[k]: kid}
                kid.label, kid.weight = kid.label[k:], kid.weight - k
                fork.weight += kid.weight
                node.kids[text[at]] = fork
                for x in path:
                    x.weight += NODE_BYTES
                kid = fork
            node, at = kid, at + len(kid.label)
            path.append(node)

    def terminals(self, top: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        """(text, smallest identifier, rows) of all texts below ``top``; ``prefix`` ends with its label."""
        todo = [(top or self.root, prefix)]
        while todo:
            node, text = todo.pop()
            if node.n:
                yield text, node.rank, node.n
            for kid in (node.kids or {}).values():
                todo.append((kid, text + kid.label))

    def spill(self, forget: bool) -> list[tuple[bytes, int | None, int]]:
        """Takes out the heaviest subtree that leaves something behind, and gives its texts.

        Where ``forget`` is false its first byte stays marked, so that later texts under it are told apart.
        A trie that holds one text alone keeps it.
        """
        path, prefix = [self.root], b""
        while True:
            node = path[-1]
            live = [kid for kid in (node.kids or {}).values() if not kid.away]
            if not live:
                return []
            kid = max(live, key=lambda x: x.weight)
            prefix += kid.label
            if any(x.n for x in path) or len(live) > 1:
                break
            path.append(kid)
        out = list(self.terminals(kid, prefix))
        if forget:
            del path[-1].kids[kid.label[0]]
            gone = kid.weight
        else:
            gone, kid.weight = kid.weight - 1 - NODE_BYTES, 1 + NODE_BYTES
            kid.label, kid.kids, kid.n, kid.rank, kid.away = kid.label[:1], None, 0, None, True
        for x in path:
            x.weight -= gone
        return out


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(_LOWER)


def _batches(rows: Iterable[tuple[bytes, int | None, int]], done: bool) -> Batches:
    """Rows of about OUT_BYTES a batch; what is done needs no text any more.

    Different texts of one length and digest would be confused then, and raise.
    """
    seen: set[tuple[int, bytes]] = set()

    def batch(some: list) -> pa.RecordBatch:
        texts, ranks, counts = zip(*some, strict=True)
        sha = [hashlib.sha256(t).digest() for t in texts]
        if done:
            keys = set(zip(map(len, texts), sha, strict=True))
            if len(keys) < len(texts) or not seen.isdisjoint(keys):
                raise ValueError("different texts of one length have the same SHA-256")
            seen.update(keys)
        columns = [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(sha, pa.binary()),
            pa.array([None] * len(texts) if done else texts, pa.binary()),
            pa.array(ranks, pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array([done] * len(texts), pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["length", "sha", "text", "rank", "n", "done"])

    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 100 if done else len(row[0]) + 100
        if size >= OUT_BYTES:
            yield batch(some)
            some, size = [], 0
    if some:
        yield batch(some)


def _own_texts(most_bytes: int):
    """A task's rows (rank, text) as one row a text, or a few where its trie had to forget."""

    def scan(batches: Batches) -> Batches:
        trie = Trie()
        for b in batches:
            for rank, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                trie.insert(normalised(text.as_py()), rank)
                while trie.weight > most_bytes and (gone := trie.spill(forget=True)):
                    yield from _batches(gone, False)
        yield from _batches(trie.terminals(), False)

    return scan


def _owners(most_bytes: int):
    """A partition's texts with owner and rows; those of subtrees set aside come back with their text."""

    def scan(batches: Batches) -> Batches:
        trie = Trie()
        for b in batches:
            late = []
            for text, rank, n in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                raw = text.as_py()
                if not trie.insert(raw, rank, n):
                    late.append((raw, rank, n))
                while trie.weight > most_bytes and (gone := trie.spill(forget=False)):
                    yield from _batches(gone, False)
            yield from _batches(late, False)
        yield from _batches(trie.terminals(), True)

    return scan


def owners(docs: DataFrame, keep: str = "largest", doc_id: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(length, sha, owner, n): one row for each distinct text, with the smallest or largest of its ids.

    ``sha`` is the SHA-256 of the normalised text in UTF-8, ``length`` its bytes.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"no such id to keep: {keep}")
    own = F.col(doc_id).cast("long")
    # tries keep the smallest rank; the complement turns the order round without overflow
    rank = F.bitwise_not(own) if keep == "largest" else own
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (total["b"] + NODE_BYTES * total["n"]) // most_bytes + 1)
    rest = docs.select(rank.alias("rank"), F.col(text).alias("text")).mapInArrow(lean(_own_texts(most_bytes)), _ROW)
    found = None
    while True:
        seen = Observation()
        dealt = rest.repartition(parts, "length", "sha").mapInArrow(lean(_owners(most_bytes)), _ROW)
        out = cut(dealt.observe(seen, F.count_if(~F.col("done")).alias("left")))
        ready = out.where("done").drop("text", "done")
        found = ready if found is None else found.union(ready)
        if not seen.get["left"]:
            break
        rest, parts = out.where("not done"), 2 * parts + 1
    owner = F.bitwise_not("rank") if keep == "largest" else F.col("rank")
    return found.select("length", "sha", owner.alias("owner"), "n")


def _digests(batches: Batches) -> Batches:
    for b in batches:
        texts = [normalised(t.as_py()) for t in b.column(1).cast(pa.binary())]
        sha = [hashlib.sha256(t).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.binary())], ["doc_id", "length", "sha"])


def deduplicate(docs: DataFrame, keep: str = "largest", doc_id: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    Only groups of two rows or more travel back to the rows. Few of them are broadcast; of many, the
    large ones are, at most HOT_SHARE of them as each holds that share of the rows, and their rows are
    dealt by id in the join that finds the others.
    """
    groups, n_groups = settled(owners(docs, keep, doc_id, text, most_bytes).where("n > 1"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(_digests), "doc_id long, length long, sha binary")
    return _told(rows, groups, n_groups)


def _told(rows: DataFrame, groups: DataFrame, n_groups: int, most_small: int = 200_000) -> DataFrame:
    side = groups.select(F.col("length").alias("__length"), F.col("sha").alias("__sha"), F.col("owner").alias("__owner"), F.col("n").alias("__n"))
    on = (F.col("length") == F.col("__length")) & (F.col("sha") == F.col("__sha"))
    owner, n = F.col("__owner"), F.col("__n")
    if n_groups <= most_small:
        met = rows.join(small(side, n_groups, most_small), on, "left")
    else:
        hot_rows = max(HOT_ROWS, groups.agg(F.sum("n")).first()[0] // HOT_SHARE + 1)
        hot = side.where(F.col("__n") >= hot_rows).toDF("__hl", "__hs", "__ho", "__hn")
        first = rows.join(F.broadcast(hot), (F.col("length") == F.col("__hl")) & (F.col("sha") == F.col("__hs")), "left")
        alone = -1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
        spread = first.withColumn("__key", F.when(F.col("__hn").isNotNull(), alone).otherwise(F.col("length")))
        met = spread.join(side.where(F.col("__n") < hot_rows), (F.col("__key") == F.col("__length")) & (F.col("sha") == F.col("__sha")), "left")
        owner, n = F.when(F.col("__hn").isNotNull(), F.col("__ho")).otherwise(owner), F.coalesce("__hn", n)
    keep_id = F.when(n.isNull(), F.col("doc_id")).otherwise(owner)
    return met.select("doc_id", keep_id.alias("keep_id"), F.coalesce(n, F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

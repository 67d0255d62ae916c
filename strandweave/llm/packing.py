"""Packing tokenized documents into fixed-length sequences: shortest-pack-first over the length histogram.

One pass tokenizes every text and cuts it into full sequences and one rest; ids are not kept,
only each piece's place, length and checksum. The histogram of lengths (at most ``size`` numbers)
goes to the driver, which fills packs from the longest length down and counts packs by pattern.
Pieces get their slot by their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep, lean, salted_rank

SIZE, END = 2048, 1
#: Distinct words whose ids a worker keeps, about 250 bytes each: the first ones, so most of the frequent ones.
MOST_WORDS = 500_000
#: Holds what the way by words relies on: cases, ends of words, accents, marks, white space of all kinds.
PROBE = "The quick, brown FOX. isn't 1,234.5 (a_b) Ünï-côdé straße\tİstanbul\n\nx\r\ny  z\u00a0w 東京 -- '' ŉ <b>."
_SPECIAL = "<|"
#: Latin letters below this are composed already and have one lower case each, but for one of them.
_PLAIN_END, _DOTTED = "\u0180", "\u0130"


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible ones for themselves, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts by way of the ids of their words, each encoded once per worker.

    The tokenizer must not join across ASCII white space, as this one does not; a text that may
    hold one of its special strings is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a word of plain letters is one token of the pre-tokenizer, and "," or "." behind it another
        self.model = self.tokenizer.model
        self.ends = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ",."}
        self.known: dict[str, bytes] = {"": b""}
        self.by_words = True
        self.by_words = self._fits(PROBE)

    def _fits(self, text: str) -> bool:
        """Whether the way by words gives the tokenizer's own ids of ``text``; another vocabulary encodes texts whole."""
        try:
            return self(text) == _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        except Exception:  # the model has no such tokens at all
            return False

    def _encode(self, words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        for k, word in enumerate(words):
            stem, end = (word[:-1], word[-1]) if word[-1] in ",." else (word, "")
            if stem.isalpha() and max(stem) < _PLAIN_END and _DOTTED not in stem:
                ids = [t.id for t in self.model.tokenize(stem.lower().encode().decode("latin-1").translate(_BYTE_LETTERS))]
                out[k] = _packed(ids + self.ends[end] if end else ids)
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = _packed(found.ids)
        return out

    def __call__(self, text: str) -> bytes:
        """The text's ids, four bytes each, the lowest first."""
        if not self.by_words or _SPECIAL in text:
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        parts = list(map(self.known.get, words))
        if None in parts:
            new = list(dict.fromkeys(w for w, ids in zip(words, parts, strict=True) if ids is None))
            found = dict(zip(new, self._encode(new), strict=True))
            if len(self.known) + len(found) <= MOST_WORDS:
                self.known.update(found)
            parts = [found[w] if ids is None else ids for w, ids in zip(words, parts, strict=True)]
        return b"".join(parts)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full sequences and one rest of each text with its end id."""
    path = path or tokenizer_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = keep(f"words of {path}", lambda: WordIds(path))
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for k, value in enumerate(batch.column(1)):
                ids = encode(value.as_py() or "") + _packed([END])
                n = len(ids) // 4
                for at in range(0, n, size):
                    piece = ids[4 * at : 4 * (at + size)]
                    row.append(k)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(scan, keeps=True), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, longest first; number of such packs), shortest pack first.

    Lengths are placed longest first, each into the packs with the most room; new packs open
    where none has room. Packs of one pattern are counted, never listed.
    """
    packs: Counter[tuple[int, ...]] = Counter()
    heap: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            while heap and not packs[heap[0][1]]:
                heapq.heappop(heap)
            if heap and heap[0][0] + length <= size:
                used, pattern = heap[0]
                n = min(left, packs[pattern])
                packs[pattern] -= n
                longer = (*pattern, length)
            else:
                used, n, longer = 0, left, (length,)
            left -= n
            if not packs[longer]:
                heapq.heappush(heap, (used + length, longer))
            packs[longer] += n
    return sorted((p, n) for p, n in packs.items() if n)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks and the sequence and offset that they go to, in order."""
    rows, first = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, n, first, offset))
            offset += x
        first += n
    rows.sort()
    out = {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "n", "sequence", "offset"))}
    before = np.cumsum(out["n"]) - out["n"]
    out["from"] = before - before[np.searchsorted(out["length"], out["length"], "left")] if rows else before
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A text's ids are followed by id 1; a null or empty text is that id alone. Texts longer than
    ``size`` are cut every ``size`` ids; those pieces fill sequences of their own. Null ids and
    repeated rows are documents like others. An empty table gives no rows. Other columns are
    ignored. Sequence ids are gapless from 0; ``size`` minus a sequence's ids is padding.
    """
    cutted = cut(pieces(docs, doc_id, text, path, size))
    histogram = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(histogram, size))
    ranked = salted_rank(cutted, ["length"], ["doc_id", "start", "ids_crc32"], ["doc_id", "start"], sum(histogram.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ranges in order of (length, first rank); a piece's range is the last that begins at or before it
        widest = int(max((table["from"] + table["n"]).max(initial=0), 0)) + 1
        begins = table["length"] * widest + table["from"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            at = np.searchsorted(begins, length * widest + rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["from"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(table["offset"][at])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(lean(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

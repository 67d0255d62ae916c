"""Document fingerprints by I-Match with several randomised lexicon subsets.

Terms whose share of documents lies in a band form the lexicon. Each subset keeps a term by a hash
of both; a document's signature in a subset hashes the sorted sequence of the distinct terms that it
shares with it. Subsets come in several densities: the dense ones tell copies from near copies, the
sparse ones see how much of a text has stayed. One more signature hashes all distinct terms, so that
texts which no subset meets are told apart too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Batches, cut, lean

#: The band, as shares of all documents.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
#: Room for the lexicon, 8 bytes a term. A document of b bytes has at most (b + 1) / 2 terms, so no more
#: than mean (b + 1) / 2 / share terms are in that share of documents: the band begins where that fits.
MOST_TERMS = 8_000_000
#: Shares of the lexicon that subsets keep, and how many subsets keep as much.
DENSITIES = ((0.75, 2), (0.25, 2), (1 / 16, 4), (1 / 64, 8), (1 / 256, 16))
#: Text of a range of ids, and the most ranges: beyond it ranges grow, and tasks stream through them.
PARTITION_BYTES, MOST_PARTS = 24_000_000, 50_000
#: Bytes of text that a task describes at once.
AT_ONCE = 4_000_000

_U = np.uint64
_LIMITS = np.array([int(d * 2**64) for d, n in DENSITIES for _ in range(n)], _U)
_SEEDS = T.mix(np.arange(1, len(_LIMITS) + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
_PLACE = _U(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1


def _terms(column: pa.Array):
    """(first row, sorted distinct term hashes of each row one after the other, borders)."""
    for lo, hi, data, offsets in T.chunks(column):
        low = T.LOWER[data]
        starts, ends = T.spans(~T.SEPARATOR[low], offsets)
        hashes, borders = T.span_hashes(low, starts, ends), T.rows_of(starts, offsets)
        sets = [np.unique(hashes[borders[k] : borders[k + 1]]) for k in range(hi - lo)]
        yield lo, np.concatenate(sets) if sets else hashes[:0], np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(term hash, documents that hold it), summed within partitions before the shuffle."""

    def scan(batches: Batches) -> Batches:
        terms, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        waiting, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([terms, *waiting])
            weights = np.concatenate([counts, *(np.ones(len(w), np.int64) for w in waiting)])
            order = np.argsort(every, kind="stable")
            every, weights = every[order], weights[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            return every[first], np.add.reduceat(weights, first) if len(first) else weights

        for batch in batches:
            for _, hashes, _ in _terms(batch.column(0)):
                waiting.append(hashes)
                size += len(hashes)
                if size > 2_000_000:
                    terms, counts = merged()
                    waiting, size = [], 0
        terms, counts = merged()
        for k in range(0, len(terms), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000])], ["term", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lean(scan), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str, n_docs: int, n_bytes: int) -> np.ndarray:
    """Sorted hashes of the terms in the band, no more than MOST_TERMS by its lower end."""
    least = max(LEAST_SHARE, (n_bytes / max(1, n_docs) + 1) / 2 / MOST_TERMS)
    low = max(2, int(np.ceil(least * n_docs)))
    found = cut(document_frequencies(docs, text).where((F.col("n") >= low) & (F.col("n") <= max(low, MOST_SHARE * n_docs))).select("term"))
    return np.sort(found.toPandas()["term"].to_numpy(np.int64).view(_U))


def _signed(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have hashes, and a 64-bit hash, not 0, of each one's sequence; ``rows`` ascend."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    if not len(first):
        return rows, np.zeros(0, _U)
    n = np.diff(np.append(first, len(rows)))
    place = (np.arange(len(rows)) - np.repeat(first, n)).astype(_U)
    sums = np.add.reduceat(T.mix(hashes ^ T.mix(place * _PLACE + _U(1))), first)
    return rows[first], np.maximum(T.mix(sums ^ (n.astype(_U) * _PLACE)), _U(1))


def signatures(column: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """A row of 64-bit signatures for each text: of all its terms, then of each subset; 0 where there is no term."""
    out = np.zeros((len(column), 1 + len(_LIMITS)), _U)
    for lo, hashes, borders in _terms(column):
        rows = np.repeat(np.arange(lo, lo + len(borders) - 1), np.diff(borders))
        of, signed = _signed(hashes, rows)
        out[of, 0] = signed
        if not len(lexicon):
            continue
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        inside = lexicon[at] == hashes
        hashes, rows = hashes[inside], rows[inside]
        for k, (limit, seed) in enumerate(zip(_LIMITS, _SEEDS, strict=True), 1):
            own = T.mix(hashes ^ seed)
            kept = np.flatnonzero(own < limit)
            of, signed = _signed(own[kept], rows[kept])
            out[of, k] = signed
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for texts of the same terms, else the share of equal signatures among the subsets that
    either text meets; 0 if neither meets any."""
    x, y = a[:, 1:], b[:, 1:]
    either = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1)
    return np.where(a[:, 0] == b[:, 0], 1.0, same / np.maximum(either, 1))


def _heads(rows: DataFrame, parts: int) -> np.ndarray:
    """The first key of each range, ascending: of the ids alone, dealt in ranges by Spark."""

    def least(batches: Batches) -> Batches:
        found = [int(batch.column(0).to_numpy().min()) for batch in batches if batch.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([min(found)], pa.int64())], ["first"])

    found = rows.select("key").repartitionByRange(parts, "key").mapInArrow(lean(least), "first long").collect()
    return np.unique(np.array([r["first"] for r in found], np.int64))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last half of the code points replaced by as many of the next document's
    first ones, in order of id (then text), the first after the last; a null id comes last. Null
    texts are empty. Texts without words share one fingerprint of zeros. Rows that repeat are each
    other's next. A table of one row is its own next; an empty one gives no rows. Other columns are
    ignored.

    Each range of ids is one task: its rows arrive sorted and pass through it a few MB at a time,
    and behind them comes the first row of the next range.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LAST)))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n_docs, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n_docs:
        return rows.select("doc_id", *[F.lit(None).cast(f.split()[-1]).alias(f.split()[0]) for f in schema.split(", ")[1:]])
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text, n_docs, n_bytes))
    heads = _heads(rows, max(1, min(MOST_PARTS, max(n_bytes // PARTITION_BYTES, n_docs // 200_000))))
    parts = len(heads)

    @F.pandas_udf("array<int>")
    def goes_to(key: pd.Series) -> pd.Series:
        """A row's range and, for those of its first key, the range before it too."""
        part = np.searchsorted(heads, key.to_numpy(), "right") - 1
        first = heads[part] == key.to_numpy()
        return pd.Series([[p, (p - 1) % parts] if f else [p] for p, f in zip(part.tolist(), first.tolist(), strict=True)])

    def describe(batches: Batches) -> Batches:
        waiting = None  # the last row, whose next has not come yet, and its signatures
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
                part = batch.slice(lo, hi - lo)
                lo = hi
                out, waiting = _described(waiting, part, words.value)
                if out is not None:
                    yield out

    role = F.posexplode(goes_to("key")).alias("role", "part")
    dealt = rows.select("doc_id", "text", "key", role).repartitionById(parts, "part").sortWithinPartitions("part", "role", "key", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.select("doc_id", "text", "role").mapInArrow(lean(describe), schema)


def _described(waiting: tuple | None, part: pa.RecordBatch, lexicon: np.ndarray) -> tuple[pa.RecordBatch | None, tuple | None]:
    """The rows whose next is known, described, and the row that waits for its own.

    Of the rows that a range gets from the one behind it only the first is anybody's next.
    """
    ids, texts, role = (part.column(k).to_pylist() for k in range(3))
    # a row of the next range counts behind one of this range, the others of them behind none
    used = [k for k in range(len(ids)) if role[k] == 0 or (role[k - 1] == 0 if k else waiting is not None)]
    if not used:
        return None, None
    plain = signatures(pa.array([texts[k] for k in used], pa.large_string()), lexicon)
    rows = [(ids[k], texts[k], role[k], x) for k, x in zip(used, plain, strict=True)]
    rows = [waiting, *rows] if waiting else rows
    own = [k for k in range(len(rows) - 1) if rows[k][2] == 0]
    last = rows[-1] if rows[-1][2] == 0 else None
    if not own:
        return None, last
    body, following = [rows[k][1] for k in own], [rows[k + 1][1] for k in own]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(body, following, strict=True)]
    a, b, c = np.stack([rows[k][3] for k in own]), signatures(pa.array(edited, pa.large_string()), lexicon), np.stack([rows[k + 1][3] for k in own])
    out = [
        pa.array([rows[k][0] for k in own], pa.int64()),
        pa.array([len(t) for t in body], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([x.astype(">u8").tobytes().hex() for x in a]),
        pa.array([x.astype(">u8").tobytes().hex() for x in b]),
        pa.array(likeness(a, b)),
        pa.array(likeness(a, c)),
    ]
    return pa.RecordBatch.from_arrays(out, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]), last

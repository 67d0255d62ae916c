"""Quality: kernel ridge regression on document statistics by random Fourier features, then isotonic calibration.

A text is described by shares and means that do not depend on its language or topic. Cosines of
random projections approximate a Gaussian kernel on them. Each partition of the labelled rows sums
its normal equations into one array of fixed size; the arrays are added up in a tree. Raw scores of
labelled rows that the ridge has not seen are counted into fixed bins, and a monotone step fit of
the bins' label shares turns them into scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Batches, crc_fold, cut, labelled, lean, with_score

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
FEATURES, RIDGE, SEED = 128, 1e-3, 11
BINS, LOW, HIGH = 400, -0.5, 1.5
#: Bound of the labelled sample, in rows; beyond it ids are taken by hash. One in CALIBRATION of them calibrates.
MOST_LABELLED, CALIBRATION = 200_000, 4
#: Arrays that one task adds up.
FAN_IN = 32

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "digits", "punctuation", "odd_endings", "bare_punctuation",
    "repeats_last", "repeats_second_last", "distinct_words", "words_per_line", "unended_lines", "beyond_ascii", "capitals_only",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122))
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_HIGH = _BYTES >= 128
_PUNCTUATION = ~(_LETTER | _DIGIT | _HIGH | T.SEPARATOR) & (_BYTES > 32) & (_BYTES < 127)
_USUAL_END = _LETTER | _DIGIT | _HIGH
_USUAL_END[[ord(c) for c in ",.;:?!'\")"]] = True
_SENTENCE_END = np.isin(_BYTES, [ord(c) for c in ".!?\""])


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; all zero where there is no word."""
    out = np.zeros((len(column), len(STATISTICS)))
    for lo, hi, data, offsets in T.chunks(column):
        starts, ends = T.spans(~T.SEPARATOR[data], offsets)
        borders = T.rows_of(starts, offsets)
        n = np.diff(borders).astype(float)
        some = n > 0
        hashes, lengths = T.span_hashes(data, starts, ends), ends - starts

        def in_bytes(flags: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

        def in_words(values: np.ndarray, borders: np.ndarray = borders) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values)])[borders])

        def marks(flags: np.ndarray, starts: np.ndarray = starts, ends: np.ndarray = ends) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return sums[ends] - sums[starts]

        words, upper, punctuation, letters = np.maximum(n, 1), _UPPER[data], _PUNCTUATION[data], _LETTER[data]
        visible = np.maximum(in_words(lengths), 1)
        mean = in_words(lengths) / words
        row_of = np.repeat(np.arange(hi - lo), np.diff(borders))
        last, second = np.zeros(len(hashes)), np.zeros(len(hashes))
        last[1:] = (hashes[1:] == hashes[:-1]) & (row_of[1:] == row_of[:-1])
        second[2:] = (hashes[2:] == hashes[:-2]) & (row_of[2:] == row_of[:-2])
        distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(borders[:-1], borders[1:], strict=True)], float)
        newline = data == 10
        before = np.zeros(len(data), bool)
        before[1:] = _SENTENCE_END[data[:-1]]
        lines = in_bytes(newline) + 1.0
        letter_words = np.maximum(in_words(marks(letters) > 0), 1)
        found = (
            np.log1p(n),
            mean,
            np.sqrt(np.maximum(in_words(lengths.astype(float) ** 2) / words - mean**2, 0)),
            in_bytes(upper) / np.maximum(in_bytes(letters), 1),
            in_bytes(_DIGIT[data]) / visible,
            in_bytes(punctuation) / visible,
            in_words(~_USUAL_END[data[ends - 1]]) / words if len(ends) else n,
            in_words(marks(punctuation) == lengths) / words,
            in_words(last) / words,
            in_words(second) / words,
            distinct / words**0.8,
            np.log1p(n / lines),
            in_bytes(newline & ~before) / lines,
            in_bytes(_HIGH[data]) / visible,
            in_words((marks(upper) == marks(letters)) & (marks(letters) > 1)) / letter_words,
        )
        out[lo:hi] = np.where(some[:, None], np.stack(found, axis=1), 0.0)
    return out


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, edges: np.ndarray, levels: np.ndarray):
        self.mean, self.spread, self.weights, self.edges, self.levels = mean, spread, weights, edges, levels

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.spread) @ self.weights

    def __call__(self, column: pa.Array) -> np.ndarray:
        return np.clip(np.interp(self.raw(statistics(column)), self.edges, self.levels), 0, 1)


def fourier(x: np.ndarray) -> np.ndarray:
    """FEATURES random cosines and a constant, for a Gaussian kernel as wide as the data."""
    draw = np.random.default_rng(SEED)
    width = x.shape[1]
    at = draw.normal(size=(width, FEATURES)) / np.sqrt(width)
    shift = draw.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -5, 5) @ at + shift), np.ones((len(x), 1))])


def monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``values``, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _sum(rows: DataFrame, sums: Callable[[Batches], np.ndarray]) -> np.ndarray:
    """The sum over partitions of the array that ``sums(batches)`` gives for each, added FAN_IN at a time."""

    def scan(batches: Batches) -> Batches:
        yield pa.RecordBatch.from_arrays([pa.array([sums(batches).ravel().tolist()], pa.list_(pa.float64()))], ["a"])

    def add(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            for row in batch.column(0):
                a = row.values.to_numpy()
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["a"])

    arrays, parts = rows.mapInArrow(lean(scan), "a array<double>"), rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        arrays = arrays.repartition(parts).mapInArrow(lean(add), "a array<double>")
    return np.sum([r["a"] for r in arrays.collect()], axis=0)


def calibrated(raw_good: np.ndarray, raw_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles of the filled bins and the monotone fit of their label shares."""
    filled = np.flatnonzero(raw_count)
    return LOW + (filled + 0.5) * (HIGH - LOW) / BINS, monotone(raw_good[filled] / raw_count[filled], raw_count[filled])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> Model:
    """Fits on the labelled rows that are not held out, about ``most`` of them at most; without any, all scores are 1.

    Beyond that bound ids are taken by a threshold on their hash. Another hash deals the rows to
    the ridge and to the calibration; if one of both gets none, each takes all.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = cut(labelled(docs, labels, "quality", FOLDS, HELD_OUT, doc_id))
    n_marks = marks.count()
    if n_marks > most:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n_marks * (1 << 30)))
    dealt = (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(CALIBRATION)) == 0).cast("int").alias("last")
    some = rows.join(F.broadcast(marks.select("doc_id", "y", dealt)), "doc_id")  # no more than a little above ``most`` ids
    width = len(STATISTICS)

    def describe(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(statistics(batch.column(0)).tolist(), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "last"])

    table = cut(some.select("text", "y", "last").mapInArrow(lean(describe), "x array<double>, y int, last int"))
    sizes = {r["last"]: r["n"] for r in table.groupBy("last").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.zeros(width), np.ones(width), np.zeros(FEATURES + 1), np.array([0.0]), np.array([1.0]))
    first, last = (table.where("last = 0"), table.where("last = 1")) if len(sizes) == 2 else (table, table)

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).flatten().to_numpy().reshape(-1, width), batch.column(1).to_numpy().astype(float)

    def moments(batches: Batches) -> np.ndarray:
        m = np.zeros((width + 1, width + 1))
        for x, _ in map(arrays, batches):
            z = np.hstack([x, np.ones((len(x), 1))])
            m += z.T @ z
        return m

    m = _sum(first, moments).reshape(width + 1, width + 1)
    n = m[-1, -1]
    mean = m[-1, :-1] / n
    spread = np.sqrt(np.maximum(np.diag(m)[:-1] / n - mean**2, 1e-8))

    def normal(batches: Batches) -> np.ndarray:
        e = np.zeros((FEATURES + 2, FEATURES + 2))
        for x, y in map(arrays, batches):
            z = np.hstack([fourier((x - mean) / spread), y[:, None]])
            e += z.T @ z
        return e

    e = _sum(first, normal).reshape(FEATURES + 2, FEATURES + 2)
    weights = np.linalg.solve(e[:-1, :-1] + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, e[:-1, -1])
    model = Model(mean, spread, weights, np.array([0.0]), np.array([1.0]))

    def bins(batches: Batches) -> np.ndarray:
        sums = np.zeros((2, BINS))
        for x, y in map(arrays, batches):
            at = np.clip((model.raw(x) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            sums += np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)
        return sums

    count, good = _sum(last, bins).reshape(2, BINS)
    model.edges, model.levels = calibrated(good, count)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7).

    Null and empty texts, and texts of white space, have statistics of 0 and the score that goes
    with them. A null id is not held out. Repeated rows score alike; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = with_score(rows, "text", model, "score")
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

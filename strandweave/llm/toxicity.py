"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares words: common subsequences of three letters, each weighted by ``DECAY`` for
every letter that it skips, spanning at most ``SPAN`` letters, normalised so that a word's kernel
with itself is 1, and raised to ``POWER`` (a product of kernels is a kernel). An insult with letters
put in between, or with an ending of its own, still shares most of its subsequences. Punctuation
inside a word is passed over and spelled-out letters are joined, so ``i.d-i*o t`` forms are seen too.

Beginning and end of a word count as letters. The machine learns from words, not from texts, so that
one insult is enough: forms that the labelled sample ties to label 1, as they are and with a letter put
in, against all forms that texts of label 0 hold and that are like them. Landmarks are spread over the
tied forms by a greedy determinant, so that forms of one stem share one, and include words of label 0 that
look most like those. The Nyström map, the inverse square root of the landmarks' kernel matrix, turns
kernel values into features; a linear machine with squared hinge loss weighs them. A text has the margins
of its TOP highest words, and a logistic curve, fitted on the sample's texts and on tied forms alone,
turns them into a score.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import crc_fold, cut, keep, labelled, lean, with_score

FOLDS, HELD_OUT = 5, 0
#: Bounds of the labelled sample, by class.
MOST_TOXIC, MOST_CLEAN = 2_000, 4_000
#: Landmarks tied to label 1, those of label 0 beside them, and how many forms are looked at for either.
LANDMARKS, CLEAN_LANDMARKS, CANDIDATES = 64, 8, 600
SPAN, DECAY, LONGEST, STEP, POWER = 5, 0.6, 14, 4, 2
#: Kernel values below this count as 0, as those of most words do.
LEAST = 0.16
SHORTEST = 4
#: Twice the log likelihood ratio that a landmark's tie to label 1 needs (odds of about 1 in 10^6 by
#: chance); where nothing reaches it, the FALLBACK best are taken.
EVIDENCE, FALLBACK = 25.0, 8
#: The least part of a form that the landmarks so far must leave over for it to become one.
LEFT_OVER = 0.35
#: Words of a text whose margins count, forms that the machine learns from at most, by frequency, how much
#: more a form's texts of label 0 weigh, and the share of them that may score 0.5 if tied forms still do.
TOP, MOST_FORMS, CLEAN_WEIGHT, CLEAN_SHARE = 3, 30_000, 20.0, 0.001
#: The margin, twice that which the machine asks for, from which a tied form is sure and must be enough alone.
SURE = 2.0
#: One in so many groups of label 0 is left to the curve.
ASIDE = 4
#: Min-wise hashes that tell near copies in the sample, and how many must agree.
HASHES, AGREE = 20, 12
MOST_SEEN = 1_500_000
#: Larger chunks than elsewhere: each one is held against all words seen before.
CHUNK_BYTES = 1 << 19
#: Words whose kernels are worked out at once, and texts whose margins a fit takes at once: a hundred places
#: a word, and several copies of a text, are what a worker holds meanwhile.
WORDS_AT_ONCE, TEXTS_AT_ONCE = 1 << 12, 256

_OFFSETS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


def _table() -> np.ndarray:
    """Bytes that words are made of: letters, digits and all of non-ASCII; 2 for separators, 0 to pass over."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[T.SEPARATOR] = 2
    return kind


_KIND = _table()


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends, borders) of the words, punctuation left out."""
    for lo, hi, data, offsets in T.chunks(column, CHUNK_BYTES):
        kind = _KIND[data]
        kept = kind > 0
        moved = np.concatenate([[0], np.cumsum(kept)])[offsets]
        clean = T.LOWER[data[kept]]
        starts, ends = T.spans(kind[kept] == 1, moved)
        yield lo, hi, clean, starts, ends, T.rows_of(starts, moved)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, borders: np.ndarray) -> list[tuple[int, str]]:
    """(row, word) of runs of four or more words of one ASCII letter."""
    single = (ends - starts == 1) & (data[np.minimum(starts, max(0, len(data) - 1))] < 128) if len(starts) else np.zeros(0, bool)
    if not single.any():
        return []
    a, b = T.spans(single, borders)
    return [(int(np.searchsorted(borders, x, "right")) - 1, bytes(data[starts[x:y]]).decode()) for x, y in zip(a, b, strict=True) if y - x >= SHORTEST]


def _portions(word: str) -> list[str]:
    """The word between marks of its beginning and end; a long one in overlapping windows, so that all of it is compared."""
    word = f"^{word}$"
    return [word] if len(word) <= LONGEST else [word[k : k + LONGEST] for k in range(0, len(word) - STEP, STEP)]


def _shorter(word: str) -> list[str]:
    """Its beginnings, which landmarks that are beginnings are compared with."""
    return [f"^{word[:k]}" for k in range(SHORTEST, min(len(word), 11), 2)]


def _symbols(words: list[str]) -> np.ndarray:
    codes = np.array(words, f"U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST).astype(np.int64)
    kinds = [codes == 0, (codes >= 97) & (codes <= 122), (codes >= 48) & (codes <= 57), codes == ord("^"), codes == ord("$")]
    return np.select(kinds, [0, codes - 96, 27, 61, 62], 28 + codes % 33)


def _triples(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(codes of three letters at one place of each word, 0 where there are none; weight)."""
    for a, b, weight in _OFFSETS:
        x, y, z = symbols[:, : LONGEST - b], symbols[:, a : LONGEST - b + a], symbols[:, b:]
        yield np.where((x > 0) & (y > 0) & (z > 0), (x << 12) | (y << 6) | z, 0), weight


def _own(symbols: np.ndarray) -> np.ndarray:
    """Each word's unnormalised kernel with itself: repeats of a subsequence add up before they are squared."""
    parts = [(codes, np.full(codes.shape[1], weight)) for codes, weight in _triples(symbols)]
    codes, weights = np.concatenate([c for c, _ in parts], axis=1), np.concatenate([w for _, w in parts])
    order = np.argsort(codes, axis=1, kind="stable")
    codes = np.take_along_axis(codes, order, axis=1)
    weights = np.where(codes > 0, weights[order], 0.0)
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    at = np.flatnonzero(first)
    return np.bincount(at // codes.shape[1], np.add.reduceat(weights.ravel(), at) ** 2, len(symbols))


#: Of three letters between two marks, or four behind one.
_SHORTEST_NORM = float(np.sqrt(_own(_symbols(["^abc$"]))[0]))


class Landmarks:
    """The kernel's values with the landmarks, and the Nyström features of words and texts."""

    def __init__(self, words: list[str]):
        self.words = words
        rows: dict[int, dict[int, float]] = {}
        for j, word in enumerate(words):
            for codes, weight in _triples(_symbols([word])):
                for code in codes[0][codes[0] > 0].tolist():
                    rows.setdefault(code, {}).setdefault(j, 0.0)
                    rows[code][j] += weight
        self.index = np.zeros(1 << 18, np.int32)
        self.weights = np.zeros((len(rows) + 1, len(words)), np.float32)
        for k, (code, of) in enumerate(rows.items(), 1):
            self.index[code] = k
            for j, w in of.items():
                self.weights[k, j] = w
        self.norms = np.sqrt((self.weights.astype(np.float64) ** 2).sum(axis=0))
        values, vectors = np.linalg.eigh(self.kernel())
        self.root = (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T).astype(np.float32)
        self.weigh(np.zeros(len(words) + 1))

    def weigh(self, v: np.ndarray) -> None:
        """Takes the machine's weights, the bias last; what was learnt about words goes."""
        self.v = v.astype(np.float64)
        self.seen, self.held = np.zeros(0, np.uint64), {}

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features.astype(np.float64) @ self.v[:-1] + self.v[-1]

    def kernel(self) -> np.ndarray:
        """The landmarks' kernel matrix."""
        g = self.weights.T.astype(np.float64) @ self.weights
        return (g / np.outer(self.norms, self.norms)) ** POWER

    def _products(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that can have a value of LEAST or more, and their unnormalised kernels with the landmarks.

        The norm of a word, and of each of its beginnings that are compared, is no less than that of
        the shortest such string without repeats.
        """
        some = np.flatnonzero(sum((self.index[codes] > 0).sum(axis=1) for codes, _ in _triples(symbols)) >= 3)
        sums = np.zeros((len(some), len(self.words)), np.float32)
        if len(some):
            for codes, weight in _triples(symbols[some]):
                at = self.index[codes]
                for column in range(at.shape[1]):
                    hit = np.flatnonzero(at[:, column])
                    sums[hit] += np.float32(weight) * self.weights[at[hit, column]]
        enough = (sums >= np.float32(0.999 * LEAST ** (1 / POWER)) * _SHORTEST_NORM * self.norms).any(axis=1)
        return some[enough], sums[enough]

    def values(self, words: list[str]) -> np.ndarray:
        """The kernel of each word, of three letters or more, and landmark; 0 below LEAST."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        for lo in range(0, len(words), WORDS_AT_ONCE):
            symbols = _symbols(words[lo : lo + WORDS_AT_ONCE])
            some, sums = self._products(symbols)
            if len(some):
                found = (sums / np.outer(np.sqrt(_own(symbols[some])), self.norms)) ** POWER
                out[lo + some] = np.where(found >= LEAST, found, 0)
        return out

    def _close(self, words: list[str]) -> list[int]:
        """Places of the words that can have a value of LEAST or more."""
        parts = range(0, len(words), WORDS_AT_ONCE)
        return [lo + k for lo in parts for k in self._products(_symbols(words[lo : lo + WORDS_AT_ONCE]))[0].tolist()]

    def features(self, words: list[str]) -> np.ndarray:
        return self.values(words) @ self.root

    def _learn(self, words: list[str], hashes: list[int]) -> None:
        parts = [(h, p) for w, h in zip(words, hashes, strict=True) for p in _portions(w)]
        if not parts:
            return
        close = {parts[k][0] for k in self._close([p for _, p in parts])}
        parts = [(h, p) for h, p in parts if h in close] + [(h, p) for w, h in zip(words, hashes, strict=True) if h in close for p in _shorter(w)]
        if not parts:
            return
        values = self.values([p for _, p in parts])
        some = np.flatnonzero(values.any(axis=1))
        for k, m in zip(some.tolist(), self.margins(values[some] @ self.root).tolist(), strict=True):
            h = parts[k][0]
            if m > self.held.get(h, self.v[-1]):
                self.held[h] = m

    def tops(self, column: pa.Array) -> np.ndarray:
        """The TOP highest margins of each text's distinct words, each the most of its portions and
        beginnings; the bias where there are fewer."""
        out = np.full((len(column), TOP), self.v[-1])

        def told(row: int, margin: float) -> None:
            if margin > out[row, -1]:
                out[row, -1] = margin
                out[row] = np.sort(out[row])[::-1]

        for lo, _, data, starts, ends, borders in _words(column):
            hashes = T.span_hashes(data, starts, ends)
            unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(self.seen, unique)
            known = self.seen[np.minimum(at, len(self.seen) - 1)] == unique if len(self.seen) else np.zeros(len(unique), bool)
            new = np.flatnonzero(~known & (ends[first] - starts[first] >= 3))
            if len(new):
                if len(self.seen) > MOST_SEEN:
                    self.seen, self.held, at = np.zeros(0, np.uint64), {}, np.zeros_like(at)
                    new = np.flatnonzero(ends[first] - starts[first] >= 3)
                raw = data.tobytes()
                words = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
                self._learn(words, unique[new].tolist())
                # both are sorted and share nothing: put in place, all words seen are neither hashed nor sorted again
                self.seen = np.insert(self.seen, at[new], unique[new])
            hits = [k for k, h in enumerate(unique.tolist()) if h in self.held] if self.held else []
            if hits:
                flags = np.zeros(len(unique), bool)
                flags[hits] = True
                places = np.flatnonzero(flags[inverse])
                rows = lo + np.searchsorted(borders, places, "right") - 1
                for row, h in sorted(set(zip(rows.tolist(), hashes[places].tolist(), strict=True))):
                    told(row, self.held[h])
            for row, word in sorted(set(_spelled(data, starts, ends, borders))):
                told(lo + row, float(self.margins(self.features(_portions(word) + _shorter(word))).max()))
        return out


def _beginnings(word: str) -> list[str]:
    """Its beginnings of some length, and the word itself with the mark of its end."""
    return [f"^{word[:k]}" for k in range(SHORTEST, min(len(word), 10) + 1)] + [f"^{word}$"] * (len(word) <= LONGEST - 2)


def _counts(sample: DataFrame) -> DataFrame:
    """(word or word beginning, groups of near copies of label 1 and of label 0 in which a document holds it).

    ``sample`` is (text, y, copies): rows that agree in ``copies`` and ``y`` count once together.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple[Counter, Counter] = Counter(), Counter()
        group, held = None, set()
        for batch in batches:
            y, copies = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, data, starts, ends, borders in _words(batch.column(0)):
                raw = data.tobytes()
                for row in range(hi - lo):
                    if (now := (copies[lo + row], y[lo + row])) != group:
                        if group:
                            of[group[1]].update(held)
                        group, held = now, set()
                    words = {raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(starts[borders[row] : borders[row + 1]].tolist(), ends[borders[row] : borders[row + 1]].tolist(), strict=True)}
                    held.update(p for w in words if len(w) >= SHORTEST for p in _beginnings(w))
        if group:
            of[group[1]].update(held)
        # what no document of label 1 holds can't become a landmark; the other counts matter only beside it
        names = sorted(of[0] | of[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([of[1][w] for w in names], pa.int64()), pa.array([of[0][w] for w in names], pa.int64())], ["name", "toxic", "clean"])

    met = sample.repartition("copies", "y").sortWithinPartitions("copies", "y").select("text", "y", "copies")
    parts = met.mapInArrow(lean(scan), "name string, toxic long, clean long")
    return parts.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def spread(candidates: list[tuple[str, float]], most: int = LANDMARKS) -> list[str]:
    """From (form, weight): forms that together span the kernel's space best, heavy ones first.

    Each is the one of the largest weight times the part of it that those before leave over (a pivoted
    Cholesky decomposition); what is nearly spanned already, such as another form of a stem, is passed over.
    """
    if not candidates:
        return []
    kernel, weight = Landmarks([c for c, _ in candidates]).kernel(), np.array([w for _, w in candidates])
    left, rows, chosen = np.ones(len(candidates)), [], []
    while len(chosen) < most:
        left[chosen] = 0.0
        gain = np.where(left >= LEFT_OVER, weight * left, 0.0)
        k = int(np.argmax(gain))
        if gain[k] <= 0:
            break
        row = (kernel[k] - sum((r[k] * r for r in rows), np.zeros(len(left)))) / np.sqrt(left[k])
        rows.append(row)
        chosen.append(k)
        left = np.maximum(left - row**2, 0.0)
    return [candidates[k][0] for k in chosen]


def disguised(text: str) -> str:
    """The text with a letter put into the middle of each word of five letters or more: a second example of its label."""
    return re.sub(r"\w{5,}", lambda m: f"{m[0][: len(m[0]) // 2]}x{m[0][len(m[0]) // 2 :]}", text)


def _inserted(form: str) -> list[str]:
    """A whole form with a letter put into each of its places, where there is room."""
    return [f"{form[:k]}x{form[k:]}" for k in range(2, len(form) - 1)] if len(form) < LONGEST else []


def lookalikes(names: list[str], marks: list[str], most: int = CLEAN_LANDMARKS) -> list[str]:
    """Of the words ``names`` those that are most like one of ``marks``."""
    if not names:
        return []
    best = Landmarks(marks).values(names).max(axis=1)
    order = sorted(range(len(names)), key=lambda k: (-best[k], names[k]))
    return [names[k] for k in order[:most] if best[k] > 0]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign, v = np.where(y > 0, 1.0, -1.0), np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        active = sign * (x @ v) < 1
        s = x[active] * weight[active, None]
        new = np.linalg.solve(s.T @ x[active] + penalty, s.T @ sign[active])
        if np.abs(new - v).max() < 1e-9:
            break
        v = new
    return v


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and intercept (last) of the score's log odds, by Newton steps with smoothed labels."""
    up, down = weight[y > 0].sum(), weight[y <= 0].sum()
    aim = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (weight * (p - aim)) + 1e-3 * v
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(v))
        move = np.linalg.solve(h, g)
        v -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return v


def curve(tops: np.ndarray, y: np.ndarray, weight: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Slopes for a text's highest margins and the intercept.

    Further words never count against a text: slopes that come out negative are 0. The intercept goes down
    until no more than CLEAN_SHARE of label 0 scores 0.5, but not below what the forms ``alone`` need.
    """
    used = list(range(tops.shape[1]))
    while True:
        v = _logistic(tops[:, used], y, weight)
        if len(used) == 1 or (v[:-1] >= 0).all():
            break
        used = [used[0]] + [k for k, slope in zip(used[1:], v[1:-1], strict=True) if slope >= 0] if (v[1:-1] < 0).any() else used[:1]
    out = np.zeros(tops.shape[1] + 1)
    out[used], out[-1] = v[:-1], v[-1]
    clean = np.sort((tops @ out[:-1] + out[-1])[y <= 0])[::-1]
    limit = max(0.0, clean[int(CLEAN_SHARE * len(clean))] + 1e-6) if len(clean) else 0.0
    need = (alone @ out[:-1] + out[-1]).min() if len(alone) else limit
    out[-1] -= min(limit, need - 1e-6) if need > 0 else need - 1e-6
    return out


class Model:
    """Scores texts; a worker keeps what it learned about words until another scan needs the room."""

    keeps = True

    def __init__(self, words: list[str], weights: np.ndarray, curve: np.ndarray):
        self.words, self.weights, self.curve = words, weights, curve
        self.key = hashlib.sha256(pickle.dumps((words, weights.tobytes(), curve.tobytes()))).hexdigest()

    def _marks(self) -> Landmarks:
        marks = Landmarks(self.words)
        marks.weigh(self.weights)
        return marks

    def __call__(self, column: pa.Array) -> np.ndarray:
        if not self.words:
            return np.zeros(len(column))
        tops = keep(self.key, self._marks).tops(column)
        return 1 / (1 + np.exp(-np.clip(tops @ self.curve[:-1] + self.curve[-1], -30, 30)))


_NOTHING = Model([], np.zeros(1), np.zeros(TOP + 1))


def _near_copies(sample: DataFrame) -> list[tuple[int, int]]:
    """(doc_id, copies) of a bounded sample (doc_id, text): texts most of whose min-wise hashes of five-word
    shingles agree are copies of one. They only weigh evidence, so an estimate is enough."""
    seeds = T.mix(np.arange(1, HASHES + 1, dtype=np.uint64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for lo, hi, data, offsets in T.chunks(batch.column(1)):
                data = T.LOWER[data]
                starts, ends = T.spans(~T.SEPARATOR[data], offsets)
                shingles, borders = T.shingles(T.span_hashes(data, starts, ends), T.rows_of(starts, offsets))
                for row in range(hi - lo):
                    own = shingles[borders[row] : borders[row + 1]]
                    least.append([int(T.mix(own ^ s).min() >> np.uint64(1)) for s in seeds] if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "least"])

    rows = sample.select("doc_id", "text").mapInArrow(lean(scan), "doc_id long, least array<long>").toPandas().sort_values("doc_id")
    ids, label = rows["doc_id"].tolist(), list(range(len(rows)))
    least = np.array([list(x) if len(x) else [-1 - k] * HASHES for k, x in enumerate(rows["least"])], np.int64).reshape(len(rows), HASHES)

    def top(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for h in range(HASHES):
        first: dict[int, int] = {}
        for k, value in enumerate(least[:, h].tolist()):
            other = first.setdefault(value, k)
            if other != k and (least[other] == least[k]).sum() >= AGREE:
                label[max(top(k), top(other))] = min(top(k), top(other))
    return [(i, ids[top(k)]) for k, i in enumerate(ids)]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most MOST_TOXIC and MOST_CLEAN labelled rows, those of the lowest hashes."""
    marks = cut(labelled(docs, labels, "toxic", FOLDS, HELD_OUT, doc_id))
    n_of = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n_of.get(1) or not n_of.get(0):
        return _NOTHING
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = marks.where("y = 1").orderBy(*order).limit(MOST_TOXIC).union(marks.where("y = 0").orderBy(*order).limit(MOST_CLEAN))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # of a repeated id the text of the least digest, so that reruns agree
    sample = cut(rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text")))
    # copies of one document say no more than it does: words are counted once a group of near copies
    copies = docs.sparkSession.createDataFrame(_near_copies(sample), "doc_id long, copies long")
    # a part of label 0 is seen by the curve only: forms that it has for itself are as new as those of other texts
    aside = (F.col("y") == 0) & (F.pmod(F.xxhash64("copies"), F.lit(ASIDE)) == 0)
    sample = cut(sample.join(F.broadcast(copies), "doc_id").select("text", "y", "copies", aside.alias("aside")))
    learnt = sample.where("not aside")
    if learnt.where("y = 0").isEmpty():
        learnt = sample
    n1, n0 = learnt.select("y", "copies").distinct().agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    t, c = F.col("toxic"), F.col("clean")
    p1, p0, p = t / F.lit(float(max(1, n1))), c / F.lit(float(max(1, n0))), (t + c) / F.lit(float(n1 + n0))

    def likelihood(k, n, p):  # of k in n at rate p, with 0 log 0 as 0
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log1p(-p)).otherwise(0.0)

    ratio = 2 * (likelihood(t, F.lit(n1), p1) + likelihood(c, F.lit(n0), p0) - likelihood(t, F.lit(n1), p) - likelihood(c, F.lit(n0), p))
    counted = cut(_counts(learnt))
    weighed = counted.where((t >= 2) & (p1 > 4 * p0)).select("name", "toxic", "clean", ratio.alias("weight"))
    best = weighed.orderBy(F.desc("weight"), F.desc(F.length("name")), "name").limit(CANDIDATES).collect()
    tied = [r for r in best if r["weight"] >= EVIDENCE] or best[:FALLBACK]
    words = spread([(r["name"], r["weight"]) for r in tied])
    if not words:
        return _NOTHING
    # words of label 0, frequent ones first, of which label 1 has no more than its share
    usual = counted.where((c >= 2) & (p0 >= p1) & F.col("name").endswith("$")).orderBy(F.desc("clean"), "name").limit(10 * CANDIDATES).select("name").collect()
    words += lookalikes([r["name"] for r in usual], words)

    def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Landmarks(words)
        for batch in batches:
            values = own.values(batch.column(0).to_pylist()).any(axis=1) if batch.num_rows else np.zeros(0, bool)
            yield batch.filter(pa.array(values))

    # forms of label 0 that are like a landmark; all others have no features
    near = counted.where((c >= 1) & (F.length("name") <= LONGEST)).select("name", "clean").mapInArrow(lean(like), "name string, clean long")
    against = near.orderBy(F.desc("clean"), "name").limit(MOST_FORMS).collect()
    own, forms = Landmarks(words), [r["name"] for r in tied]
    share = {r["name"]: r["toxic"] / n1 for r in tied}
    changed = [(z, w) for name in forms if name.endswith("$") for z in _inserted(name) for w in [0.5 * share[name] / (len(name) - 3)]]
    x = own.features([*forms, *[z for z, _ in changed], *[r["name"] for r in against]])
    y = np.array([1] * (len(forms) + len(changed)) + [0] * len(against))
    weight = np.array([share[z] for z in forms] + [w for _, w in changed] + [CLEAN_WEIGHT * r["clean"] / max(1, n0) for r in against])
    # a text without any form like these: nothing of it may count
    x, y, weight = np.vstack([x, np.zeros((1, x.shape[1]))]), np.append(y, 0), np.append(weight, 1.0)
    v = _machine(x.astype(np.float64), y, weight / weight.mean())

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Landmarks(words)
        own.weigh(v)
        for batch in (b.slice(k, TEXTS_AT_ONCE) for b in batches for k in range(0, b.num_rows, TEXTS_AT_ONCE)):
            for texts in (batch.column(0), pa.array([disguised(t) for t in batch.column(0).to_pylist()], pa.string())):
                yield pa.RecordBatch.from_arrays([pa.array(own.tops(texts).tolist(), pa.list_(pa.float64())), *batch.columns[1:]], ["x", "y", "aside"])

    got = sample.select("text", "y", "aside").mapInArrow(lean(pool), "x array<double>, y int, aside boolean").toPandas()
    got = got[(got["y"] > 0) | got["aside"]] if got["aside"].any() else got
    own.weigh(v)
    # sure words alone, as they are and with a letter put in, weigh as much as all texts of label 1
    pure = [r["name"] for r in tied if r["name"].endswith("$") and not r["clean"] and r["weight"] >= EVIDENCE]
    tops = own.tops(pa.array([z.strip("^$") for z in pure], pa.string())) if pure else np.zeros((0, TOP))
    sure = tops[:, 0] >= SURE
    alone, forms = tops[sure], [z for z, s in zip(pure, sure, strict=True) if s]
    single = np.vstack([alone, own.tops(pa.array([w.strip("^$") for z in forms for w in _inserted(z)], pa.string()))])
    x, y = np.vstack([np.array(got["x"].tolist(), np.float64).reshape(-1, TOP), single]), np.append(got["y"].to_numpy(), np.ones(len(single)))
    weight = np.append(np.ones(len(got)), np.full(len(single), (got["y"] > 0).sum() / max(1, len(single))))
    return Model(words, v, curve(x, y, weight, alone))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.5).

    Null and empty texts hold no landmark and get the score of a text without any. A null id is
    not held out. Repeated rows score alike; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = with_score(rows, "text", model, "score")
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

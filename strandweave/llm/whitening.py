"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the spectrum of its vectors' centred scatter and takes them in one at a time: a
vector is a rank-one update of the scatter, whose new eigenvalues are the roots of a secular equation;
components that the update does not touch, and pairs of equal eigenvalues, are deflated first. Spectra
of partitions are combined by one rank-one update for each of the other's components and one for the
distance of the means, FAN_IN partitions a task. The leading subspace found so is refined by a
Rayleigh-Ritz step over all partitions: the covariance is applied to it in one pass, and again while
the residual is above RESIDUAL.

Entries become integers first, so that sums, n and deviations are exact. Passes over the fit list, each
distinct vector once, give one small array a task; dims x dims numbers are the most that meets anywhere.

Rows whose vector is null or empty, or holds a null or non-finite entry, are left out; the others must be
of one length and within MOST, else this raises. A null id is a row like others; repeated rows come back as
often. A component along which the fit list does not vary has no whitened value (null), explains 0, and
counts in no identity error. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut, lean

SCALE, COMPONENTS = 256, 4
#: The largest absolute entry after scaling.
MOST = 1 << 40
#: Partitions whose spectra one task combines, and extra directions that the refinement carries along.
FAN_IN, EXTRA = 16, 8
#: The residual of an eigenpair, relative to the largest eigenvalue, at which the refinement ends.
RESIDUAL, MOST_REFINEMENTS = 1e-13, 50
_EPS = np.finfo(float).eps


def _roots(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``d_i - root_j`` for the roots of 1 + sum(w_i / (d_i - x)) = 0, for ascending d and positive w.

    Root j lies between d_j and the next pole, the last one within sum(w) above the last. Each is found
    as its distance from the nearer pole, so that the differences lose no digits, by the interpolation
    of Li ("Solving secular equations stably and efficiently") inside a bracket.
    """
    m = len(d)
    gap = np.append(np.diff(d), w.sum())
    if m == 1:
        return np.array([[-w[0]]])
    lower = np.tri(m).T  # i <= j
    j = np.arange(m)
    up = np.minimum(j + 1, m - 1)
    seen = 1 / (d[:, None] - d - gap / 2)
    middle = 1 + w @ seen
    right = middle < 0
    right[-1] = False
    delta = d[:, None] - d[j + right]
    lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    if middle[-1] < 0:
        lo[-1], hi[-1] = gap[-1] / 2, gap[-1]
    # a first guess with the two nearest poles, and the others as they are in the middle
    rest = middle - w * seen[j, j] - w[up] * seen[up, j]
    p1, p2 = delta[j, j], delta[up, j]
    t = _bracketed(_quadratic(rest * (p1 + p2) + w + w[up], rest * p1 * p2 + w * p2 + w[up] * p1, rest), lo, hi)
    t[-1] = (lo[-1] + hi[-1]) / 2
    open_ = j
    for _ in range(80):
        k, now = open_, t[open_]
        with np.errstate(all="ignore"):
            x = delta[:, k] - now
            r = 1 / x
            r2 = r * r
            f, all_ = 1 + w @ r, w @ r2
            left = w @ (r2 * lower[:, k])
            scale = f - 2 * (w @ (r * lower[:, k]))  # 1 and all terms without their signs
            above = f > 0
            hi[k], lo[k] = np.where(above, now, hi[k]), np.where(above, lo[k], now)
            done = (np.abs(f) <= 8 * _EPS * scale) | (hi[k] - lo[k] <= 2 * _EPS * np.abs(now))
            n = np.arange(len(k))
            a1, a2 = x[k, n], x[up[k], n]
            step = _quadratic((a1 + a2) * f - a1 * a2 * all_, a1 * a2 * f, f - a1 * left - a2 * (all_ - left))
            if k[-1] == m - 1:  # all poles are on one side of the last root: those before the last are taken as one
                p, q = x[m - 2, -1], x[m - 1, -1]
                share = (all_[-1] - w[-1] / (q * q)) * p * p
                c = f[-1] - share / p - w[-1] / q
                a, b = c * (p + q) + share + w[-1], f[-1] * p * q
                root = np.sqrt(np.abs(a * a - 4 * b * c))
                step[-1] = 2 * b / (a - root) if a < 0 else (a + root) / (2 * c)
        more = ~done
        open_ = k[more]
        if not len(open_):
            break
        t[open_] = _bracketed((now + step)[more], lo[open_], hi[open_])
    return delta - t


def _quadratic(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The root of c x^2 - a x + b that is small where b is, without cancellation."""
    with np.errstate(all="ignore"):
        root = np.sqrt(np.abs(a * a - 4 * b * c))
        return np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))


def _bracketed(t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.where((t > lo) & (t < hi), t, (lo + hi) / 2)


def _updated(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of ``vectors diag(values) vectors^T + weight x x^T``."""
    z = vectors.T @ x
    size = weight * float(z @ z)
    if size <= 0:
        return values, vectors
    z = z / np.sqrt(z @ z)
    tolerance = 8 * _EPS * max(float(np.abs(values).max()), size)
    touched = size * np.abs(z) > tolerance
    live = np.flatnonzero(touched)
    close = np.flatnonzero(np.diff(values[live]) <= tolerance)
    if len(close):  # a rotation within equal eigenvalues leaves one of the two untouched
        vectors = vectors.copy()
        for k in close.tolist():
            a, b = live[k], live[k + 1]
            r = np.hypot(z[a], z[b])
            cos, sin = z[b] / r, z[a] / r
            va, vb = vectors[:, a].copy(), vectors[:, b].copy()
            vectors[:, a], vectors[:, b] = cos * va - sin * vb, sin * va + cos * vb
            z[a], z[b], touched[a] = 0.0, r, False
        live = np.flatnonzero(touched)
    if not len(live):  # too small an update to tell
        return values, vectors
    d, w = values[live], size * z[live] ** 2
    differences = _roots(d, w)
    # the weights that have exactly these roots make the new vectors orthogonal (Gu and Eisenstat)
    poles = d[:, None] - d
    np.fill_diagonal(poles, 1.0)
    exact = np.sqrt(np.abs(np.prod(differences / poles, axis=1)))
    turned = np.copysign(exact, z[live])[:, None] / differences
    turned /= np.sqrt((turned**2).sum(axis=0))
    new_values, new_vectors = values.copy(), vectors.copy()
    # d_j less (d_j - root_j)
    new_values[live] = d - np.diagonal(differences)
    new_vectors[:, live] = vectors[:, live] @ turned
    order = np.argsort(new_values, kind="stable")
    return np.maximum(new_values[order], 0.0), new_vectors[:, order]


class Spectrum:
    """Number, mean and eigenpairs of the centred scatter of some vectors, and their exact sums."""

    def __init__(self, dims: int):
        self.n, self.mean = 0, np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)
        self.sums = [0] * dims

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        if self.n:
            self.values, self.vectors = _updated(self.values, self.vectors, off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def join(self, other: Spectrum) -> Spectrum:
        if not self.n or not other.n:
            return self if self.n else other
        n, off = self.n + other.n, other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = _updated(self.values, self.vectors, vector, value)
        self.values, self.vectors = _updated(self.values, self.vectors, off, self.n * other.n / n)
        self.n, self.mean = n, self.mean + off * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return self

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean.tolist(), "ev": self.values.tolist(), "vectors": self.vectors.ravel().tolist(), "sums": [str(s) for s in self.sums]}

    @staticmethod
    def of(row) -> Spectrum:
        out = Spectrum(len(row["mean"]))
        out.n, out.mean, out.values = int(row["n"]), np.array(row["mean"], float), np.array(row["ev"], float)
        out.vectors, out.sums = np.array(row["vectors"], float).reshape(len(out.mean), -1), [int(s) for s in row["sums"]]
        return out


_STATE = "n long, mean array<double>, ev array<double>, vectors array<double>, sums array<string>"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _added(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    return [int(s) for s in (x.sum(axis=0) if not len(x) or np.abs(x).max() < (1 << 62) // len(x) else x.astype(object).sum(axis=0))]


def spectrum(fit: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all vectors of (x), combined over its partitions."""

    def scan(batches: Batches) -> Batches:
        own = Spectrum(dims)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            own.sums = [a + b for a, b in zip(own.sums, _added(x), strict=True)]
            for row in x.astype(float):
                own.add(row)
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row()], pa.schema(_FIELDS))

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("part").to_dict("records")
        one = reduce(Spectrum.join, map(Spectrum.of, rows))
        return pd.DataFrame([{"part": rows[0]["part"] // FAN_IN, **one.row()}])

    number = F.spark_partition_id().cast("long").alias("part")
    states, most = cut(fit.select("x").mapInArrow(lean(scan), _STATE).select(number, "*")), FAN_IN
    parts = states.agg(F.max("part")).first()[0]
    while parts is not None and parts > 0:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(joined, f"part long, {_STATE}")
        parts //= most
    rows = states.collect()
    return Spectrum.of(rows[0]) if rows else Spectrum(dims)


_FIELDS = [
    pa.field("n", pa.int64()),
    pa.field("mean", pa.list_(pa.float64())),
    pa.field("ev", pa.list_(pa.float64())),
    pa.field("vectors", pa.list_(pa.float64())),
    pa.field("sums", pa.list_(pa.string())),
]


def _total(fit: DataFrame, arrays: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of the small array that ``arrays(batches)`` gives for each partition, added up by Spark place by place."""

    def scan(batches: Batches) -> Batches:
        a = arrays(batches).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a))), pa.array(a)], ["at", "a"])

    sums = fit.select("x").mapInArrow(lean(scan), "at long, a double").groupBy("at").agg(F.array_sort(F.collect_list("a")).alias("a"))
    # in order of size, so that reruns agree to the last digit
    added = sums.select("at", F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("a"))
    return np.array([r["a"] for r in added.orderBy("at").collect()])


class Whitening:
    """Means as exact sums over n, components by falling eigenvalue, their share of the trace."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace
        self.flat = self.values <= 1e-12 * max(self.trace, 0.0) if trace > 0 else np.ones(len(values), bool)
        self.identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean. The mean's whole part goes first, exactly, so that large entries lose nothing."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s - int(w) * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - whole) - part

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; not a number along components without variance."""
        root = np.where(self.flat, np.nan, np.sqrt(np.maximum(self.values, 0)))
        return self.centred(x) @ self.vectors / root

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - sum)^2 of each row; None where it does not fit in a long."""
        s = np.array(self.sums, object)
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if top < 1 << 62 and x.shape[1] * top * top < 1 << 63:
            off = self.n * x - s.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = (((self.n * x.astype(object)) - s) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def _longs(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    far = F.exists(v, lambda c: F.abs(c.cast("double") * scale) > float(MOST))
    checked = F.when(far, F.raise_error(F.lit(f"an entry beyond {MOST / scale}"))).otherwise(whole)
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad).withColumn("__x", checked)


def fitted(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of (x), distinct vectors of ``dims`` longs each, to double precision."""
    first = spectrum(fit, dims)
    k = min(components, dims)
    if not first.n:
        return Whitening(0, [0] * dims, np.eye(dims)[:, :k], np.zeros(k), 0.0)
    model = Whitening(first.n, first.sums, np.eye(dims), np.ones(dims), 1.0)
    basis = first.vectors[:, ::-1][:, : min(dims, k + EXTRA)]
    values, trace = np.zeros(k), 0.0
    for _ in range(MOST_REFINEMENTS):
        q = np.linalg.qr(basis)[0]

        def applied(batches: Batches, q: np.ndarray = q) -> np.ndarray:
            out, squares = np.zeros((dims, q.shape[1])), 0.0
            for batch in batches:
                x = model.centred(_matrix(batch.column(0), dims))
                out += x.T @ (x @ q)
                squares += float((x * x).sum())
            return np.append(out.ravel(), squares)

        sums = _total(fit, applied) / first.n
        trace, product = sums[-1], sums[:-1].reshape(dims, -1)
        inner = q.T @ product
        found, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-found, kind="stable")
        values, turn = found[order], turn[:, order]
        basis, image = q @ turn, product @ turn
        residual = np.abs(image - basis * values)[:, :k].max()
        if residual <= RESIDUAL * max(values[0], 0.0) or q.shape[1] == dims:
            break
        # the covariance's image holds more of the leading components than what it was applied to
        basis = image
    vectors = basis[:, :k]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(k)])
    out = Whitening(first.n, first.sums, vectors * signs, values[:k], trace)

    def products(batches: Batches) -> np.ndarray:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = np.hstack([np.where(out.flat, 0.0, out(_matrix(batch.column(0), dims))), np.ones((batch.num_rows, 1))])
            total += w.T @ w
        return total

    m = _total(fit, products).reshape(k + 1, k + 1) / first.n
    # whitened means are 0 but for rounding
    off = np.abs(m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1]) - np.eye(k))[np.ix_(~out.flat, ~out.flat)]
    out.identity_error = float(off.max()) if off.size else None
    return out


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each kept row and component."""
    kept = _longs(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("__v")), "__v", scale).select("vec_id", F.col("__x").alias("x"))
    size = kept.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.max(F.array_max(F.transform("x", F.abs))).alias("top")).first()
    if size["least"] != size["most"]:
        raise ValueError(f"vectors of different lengths, {size['least']} to {size['most']}")
    dims = size["most"] or 1
    narrow = next(t for t, bits in (("short", 15), ("int", 31), ("long", 63)) if (size["top"] or 0) < 1 << bits)
    fit = cut(kept.select(F.col("x").cast(f"array<{narrow}>").alias("x")).distinct())
    model = fitted(fit, dims, components)
    k = len(model.values)

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = _matrix(some.column(1), dims)
                white, n = model(x), len(x)
                explained = np.where(model.flat, 0.0, model.values / (model.trace or 1.0))
                ids = some.column(0).take(pa.array(np.repeat(np.arange(n), k)))
                columns = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                    pa.array(np.full(n * k, model.n), pa.int64()),
                    pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel())),
                    pa.array(np.tile(explained, n), pa.float64()),
                    pa.array([model.identity_error] * (n * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(lean(scan), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")

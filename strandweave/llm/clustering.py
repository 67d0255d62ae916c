"""Centroid clustering in integers with an equal-average equal-variance search for the nearest centroid.

For vectors x and c of d components, with sums s and deviations v (the length of the vector less its
mean), the squared distance is at least ((s_x - s_c)^2 / d) + (v_x - v_c)^2. Centroids are sorted by
their mean; the search starts beside a vector's own mean and goes outward: once the part of the means
alone exceeds the best distance the whole side is done, and a centroid whose two parts exceed it is
passed over. These tests are in floating point with a margin on the safe side; every distance that
decides is an exact integer, and equal ones go to the smaller number.

Each round is one pass over the vectors: a task assigns its own and gives, for each centroid, count,
component sums and the sum of distances, so that a cluster of a third of all rows is as many small
rows as there are tasks. Only centroids (K x DIMS integers) come to the driver and go to the tasks.

Rows without DIMS components, or with a null or non-finite one, are left out. Components beyond
MOST raise, as squared distances would not fit in a long. Repeated rows each count; a null id is
assigned like others and starts a centroid only where ids are too few. With fewer than K vectors there are fewer centroids; an
empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, lean

K, ROUNDS, SEED, DIMS, SCALE = 8, 10, 3, 64, 1024
#: The largest component after scaling: 64 squares of twice as much stay below 2^63.
MOST = 1 << 26
#: Vectors that are searched for at once.
BLOCK = 8_192


class Search:
    """The nearest of some centroids, by mean and deviation first."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.c = centroids[self.order]
        self.s = sums[self.order].astype(float)
        self.v = _deviation(self.c, self.s)
        self.tried = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row."""
        n, k, d = len(x), len(self.c), x.shape[1]
        s = x.sum(axis=1).astype(float)
        v = _deviation(x, s)
        right = np.searchsorted(self.s, s)
        left = right - 1
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        open_ = np.arange(n)
        while len(open_):
            lo, hi = left[open_], right[open_]
            below = np.where(lo >= 0, s[open_] - self.s[np.maximum(lo, 0)], np.inf)
            above = np.where(hi < k, self.s[np.minimum(hi, k - 1)] - s[open_], np.inf)
            near = np.minimum(below, above)
            bound = best[open_] * (1 + 1e-9) + 1
            mean = near * near / d
            # the nearer side is too far, so all that is left is
            go = (near < np.inf) & (mean <= bound)
            open_, lo, hi, below, above, bound, mean = (a[go] for a in (open_, lo, hi, below, above, bound, mean))
            down = below <= above
            at = np.where(down, lo, hi)
            left[open_[down]] -= 1
            right[open_[~down]] += 1
            close = mean + (v[open_] - self.v[at]) ** 2 <= bound
            rows, at = open_[close], at[close]
            self.tried += len(rows)
            difference = x[rows] - self.c[at]
            exact = np.einsum("ij,ij->i", difference, difference)
            own = self.order[at]
            better = (exact < best[rows]) | ((exact == best[rows]) & (own < number[rows]))
            best[rows[better]], number[rows[better]] = exact[better], own[better]
        return number, best


def _deviation(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - s[:, None] / x.shape[1]) ** 2).sum(axis=1))


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    """Vectors of equal length as scaled integers, rounded down."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    whole = np.floor(x * scale)
    if len(whole) and np.abs(whole).max() > MOST:
        raise ValueError(f"a component beyond {MOST / scale}: squared distances would not fit in a long")
    return whole.astype(np.int64)


def vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS) -> DataFrame:
    """(vec_id, v): rows with exactly ``dims`` components, all of them numbers."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) == dims) & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _blocks(batches: Batches, scale: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            yield some, _integers(some.column(some.schema.get_field_index("v")), scale)


def _sums(centroids: np.ndarray, scale: int) -> Callable[[Batches], Batches]:
    """For each centroid that a task assigns something to: (cluster, n, sums, inertia)."""

    def scan(batches: Batches) -> Batches:
        search, k = Search(centroids), len(centroids)
        # Python integers, as a task's sums may pass 2^63
        count, inertia, sums = [0] * k, [0] * k, np.zeros((k, centroids.shape[1]), object)
        for _, x in _blocks(batches, scale):
            number, distance = search.nearest(x)
            for c in np.unique(number):
                own = number == c
                count[c] += int(own.sum())
                inertia[c] += _exact(distance[own])
                sums[c] += x[own].sum(axis=0).astype(object)
        some = [c for c in range(k) if count[c]]
        wide = pa.decimal128(38, 0)
        columns = [pa.array(some, pa.int32()), pa.array([count[c] for c in some], pa.int64()), pa.array([[*sums[c], inertia[c]] for c in some], pa.list_(wide))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    return scan


def _exact(values: np.ndarray) -> int:
    """The sum of non-negative longs, in two halves that can't overflow."""
    return (int((values >> 31).sum()) << 31) + int((values & 0x7FFFFFFF).sum())


def _round(rows: DataFrame, centroids: np.ndarray, scale: int) -> list[tuple[int, int, list[int], int]]:
    """(cluster, n, component sums, inertia) of every cluster that is not empty."""
    parts = rows.select("v").mapInArrow(lean(_sums(centroids, scale)), "cluster int, n long, sums array<decimal(38,0)>")
    width = centroids.shape[1] + 1
    each = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    return [(r["cluster"], r["n"], [int(x) for x in r["sums"][:-1]], int(r["sums"][-1])) for r in each.collect()]


def cluster(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector.

    Centroids start as the ``k`` vectors whose ``seed:id`` has the smallest SHA-256, in its order
    (repeated ids: in order of their vectors), and move to the floor of their vectors' mean in each
    of ``rounds`` rounds; one without vectors stays where it is.
    """
    kept = vectors(rows, vec_id, vector, dims)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    centroids = np.floor(np.array([r["v"] for r in first], float).reshape(len(first), dims) * scale).astype(np.int64)
    if len(centroids):
        for _ in range(rounds):
            moved = centroids.copy()
            for c, n, sums, _ in _round(kept, centroids, scale):
                moved[c] = [s // n for s in sums]
            centroids = moved
    totals = {c: inertia for c, _, _, inertia in _round(kept, centroids, scale)} if len(centroids) else {}
    whole = sum(totals.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def scan(batches: Batches) -> Batches:
        search = Search(centroids)
        for some, x in _blocks(batches, scale):
            number, distance = search.nearest(x)
            columns = [
                some.column(0),
                pa.array(number, pa.int32()),
                pa.array(distance, pa.int64()),
                pa.array([totals[c] for c in number.tolist()], pa.int64()),
                pa.array([whole] * len(number), pa.int64()),
                pa.array([digests[c] for c in number.tolist()], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return kept.mapInArrow(lean(scan), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

"""Exact top-k search in binary codes by incremental multi-index hashing.

A code is the signs of a vector, cut into segments. Codes within distance r of a query agree with
it in some segment up to r // segments bits. Each round lets every unfinished query probe its
segments at one more bit of distance and verifies the new codes; after radius s all codes within
segments * (s + 1) - 1 are known, and a query is finished when its kth distance is no more.
The index holds distinct codes, each with its k smallest ids, so a vector that many rows share is
one entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, salts

BITS, K, EVERY = 64, 10, 50
#: Parts in which a query's hits are ranked before they meet.
SALTS = 32


def code_of(vector: Column, bits: int = BITS) -> Column:
    """Signs (above 0: 1) of the first ``bits`` entries as a long, the first in the lowest bit; missing and null entries count as 0."""
    return F.aggregate(
        F.transform(F.slice(vector, 1, bits), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        F.lit(0).cast("long"),
        lambda acc, e: F.when(e["x"] > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e["i"]))).otherwise(acc),
    )


def segments_of(n_codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width): segments about as wide as the index has bits of codes, at least two."""
    m = max(2, min(8, round(bits / max(4.0, math.log2(max(2, n_codes)) - 2))))
    edges = [round(k * bits / m) for k in range(m + 1)]
    return list(zip(edges, [b - a for a, b in zip(edges, edges[1:], strict=False)], strict=False))


def _segment(code: str, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _prober(segments: list[tuple[int, int]], radius: int):
    """For each query code, the segment values that differ from its own in exactly ``radius`` bits."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {w: np.array([sum(1 << b for b in at) for at in combinations(range(w), radius)], np.int64) for w in {w for _, w in segments}}
        for batch in batches:
            q = batch.column(0).to_numpy()
            for s, (low, width) in enumerate(segments):
                own = ((q.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)).view(np.int64)
                step = max(1, 200_000 // max(1, len(masks[width])))
                for k in range(0, len(q), step) if len(masks[width]) else ():
                    value = (own[k : k + step, None] ^ masks[width]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[k : k + step], len(masks[width]))), pa.array(np.full(len(value), s, np.int32)), pa.array(value)], ["q", "seg", "value"])

    return probe


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, bits: int = BITS) -> DataFrame:
    """The k nearest rows of each query: query_id, neighbor_id, distance, rank from 1.

    Queries are the rows whose id is divisible by ``every``; a query is not its own neighbour. Ties
    in distance go to the smaller id. Rows with a null id or vector are left out; rows that repeat
    an id count once (the smallest code); with fewer than k other rows all of them come. Other
    columns are ignored.
    """
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), code_of(F.col(vector), bits).alias("code"))
    rows = cut(rows.groupBy("id").agg(F.min("code").alias("code")))
    n = rows.count()
    # each distinct code with its k + 1 smallest ids (one may be the query itself), hot codes salted
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts(n, 1_000_000, 32))))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    codes = cut(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n_codes = codes.count()
    segments = segments_of(n_codes, bits)
    index = codes.select("code", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment("code", low, width).alias("value")) for s, (low, width) in enumerate(segments)])).alias("at")).select("code", "at.*")
    index = cut(index.repartition("seg", "value"))

    # queries of one code share a search; it needs the k + 1 nearest ids, one of which may be the query
    queries = rows.where(F.col("id") % every == 0)
    open_codes = cut(queries.select(F.col("code").alias("q")).distinct())
    reach = k + 1
    top = Window.partitionBy("q").orderBy("distance", "id")
    best, finished = None, []
    for radius in range(max(w for _, w in segments) + 1):
        if open_codes.isEmpty():
            break
        probes = open_codes.mapInArrow(lean(_prober(segments, radius)), "q long, seg int, value long")
        met = probes.join(index, ["seg", "value"]).select("q", "code").distinct()
        found = met.select("q", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("long").alias("distance"), "code")
        # the reach nearest codes hold the reach nearest ids
        # no id of the reach nearest can belong to a code that this many nearer ones precede
        # (first among the hits of each salt: a query that many codes are near to is not gathered whole)
        part = found.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)))
        part = part.withColumn("r", F.rank().over(Window.partitionBy("q", "salt").orderBy("distance"))).where(F.col("r") <= reach)
        near = part.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy("distance"))).where(F.col("r") <= reach)
        hits = near.join(codes, "code").select("q", "distance", F.explode("ids").alias("id"))
        hits = hits if best is None else hits.union(best.join(open_codes, "q", "left_semi").select("q", "distance", "id")).distinct()
        best = cut(hits.withColumn("r", F.row_number().over(top)).where(F.col("r") <= reach))
        covered = len(segments) * (radius + 1) - 1
        last = best.groupBy("q").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
        done = last.where((F.col("n") >= min(reach, n)) & (F.col("far") <= covered)).select("q")
        finished.append(best.join(done, "q", "left_semi").select("q", "distance", "id"))
        open_codes = cut(open_codes.join(done, "q", "left_anti"))
    else:
        finished.append(best.join(open_codes, "q", "left_semi").select("q", "distance", "id"))
    every_hit = finished[0] if finished else rows.select(F.col("code").alias("q"), F.lit(0).cast("long").alias("distance"), "id").where("false")
    for more in finished[1:]:
        every_hit = every_hit.union(more)
    own = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(every_hit, "q").where("query_id <> id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("id").alias("neighbor_id"), "distance", F.col("rank").cast("int").alias("rank"))

"""Sharding with whole groups of equal texts: longest-processing-time scheduling.

Groups larger than a fixed fraction of all bytes are scheduled one by one; their number is bounded
by that fraction. Smaller groups are bundled by size class and hash of the text, and the bundles
are scheduled in the same order of size, so the driver's heap sees a bounded number of units
whatever the number of documents.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_rank

SHARDS = 16
#: A group of more than 1/LARGE of all bytes is a unit of its own: fewer than LARGE units.
LARGE = 2048
#: Bundles of each size class; there are at most 64 classes.
BUNDLES = 128


def schedule(units: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Largest first, each to the shard with the least so far; ties by name, then shard."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for size, name in sorted(units, key=lambda u: (-u[0], u[1])):
        load, k = heapq.heappop(heap)
        out[name] = k
        heapq.heappush(heap, (load + size, k))
    return out


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text plus 1. Equal texts go to one shard; null counts as empty.
    Shards are as even in bytes as whole groups allow. Slots are gapless from 0 in each shard.
    grown_shard is null under this law. Null ids and repeated rows are documents like others; an
    empty table gives no rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    raw = body.cast("binary")
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("group")))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    large = cut(groups.where(F.col("size") * LARGE > total).select("group", "size"))
    of_group = F.lower(F.hex("l.group"))
    united = rows.alias("r").join(F.broadcast(large.select("group").alias("l")), F.col("r.group") == F.col("l.group"), "left").select("r.doc_id", "r.size", "r.text_crc32", F.coalesce(of_group, bundle_of("r")).alias("unit"))
    units = [(r["size"], r["unit"]) for r in united.groupBy("unit").agg(F.sum("size").alias("size")).collect()]
    placed = schedule(units, shards)
    of_unit = docs.sparkSession.createDataFrame([(u, k) for u, k in placed.items()], "unit string, shard int")
    dealt = united.join(F.broadcast(of_unit), "unit").select("doc_id", "size", "text_crc32", "shard")
    ranked = salted_rank(dealt, ["shard"], ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32"], n_rows, "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def bundle_of(alias: str):
    """A bundle's name: the class of the text's size and a hash of the text."""
    size, group = F.col(f"{alias}.size"), F.col(f"{alias}.group")
    return F.concat_ws(".", F.floor(F.log2(size)).cast("string"), F.pmod(F.xxhash64(group), F.lit(BUNDLES)).cast("string"))

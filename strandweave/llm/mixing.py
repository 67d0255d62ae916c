"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Each document has a 48-bit hash. Sizes are summed by source and leading bits of the hash; the
bucket in which a source's budget runs out is refined by the next bits, level by level, until it
holds a document or none. Documents below the threshold are taken once more than the others; no
sort is needed. What the threshold leaves of a budget, less than one document, goes to the
document that fills it best, a few times over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small

MOST_EPOCHS, BITS, LEVEL_BITS, TOP_UPS = 3, 48, 12, 3


def size_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 64 - BITS)


def targets(per_source: DataFrame) -> DataFrame:
    """Adds weight and target to (source, source_size): the level at which shares by weight, cut at
    three times a source's size, use up all sizes."""
    everything = Window.partitionBy()
    ordered = per_source.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    ratio = (MOST_EPOCHS * F.col("source_size") / F.col("weight")).alias("ratio")
    by_ratio = Window.orderBy("ratio", "weight", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = ordered.select("*", ratio).select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum(MOST_EPOCHS * F.col("source_size")).over(before), F.lit(0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("full_weight"),
        F.row_number().over(by_ratio).alias("place"),
    )
    level = ((F.col("total") - F.col("full")) / (F.col("weights") - F.col("full_weight"))).alias("level")
    # the first source, by ratio, that the level of those before it leaves below its cap
    below = F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))
    reached = levels.select("*", level).select("*", F.min(below).over(everything)["level"].alias("at"))
    cap = (MOST_EPOCHS * F.col("source_size")).cast("double")
    return reached.select("source", "source_size", "weight", F.when(F.col("at").isNull(), cap).otherwise(F.least(cap, F.col("weight") * F.col("at"))).alias("target"))


def mix_plan(sized: DataFrame) -> tuple[DataFrame, int]:
    """From (source, size, h): one row per source with its target, whole epochs, hash threshold
    and top-ups; and the number of sources."""
    per_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    counted = cut(per_source)
    n_sources, n_rows = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    levels = min(BITS // LEVEL_BITS, max(1, math.ceil((math.log2(max(2, n_rows)) + 6) / LEVEL_BITS)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets(counted.select("source", "source_size")).withColumn("epochs", F.least(epochs, F.lit(MOST_EPOCHS).cast("long")))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    plan = cut(plan)

    def joined(rows: DataFrame, side: DataFrame, on: Column = F.lit(True)) -> DataFrame:
        return rows.alias("r").join(small(side.alias("p"), n_sources), F.col("r.source").eqNullSafe(F.col("p.source")) & on)

    for level in range(levels):
        shift, above = BITS - (level + 1) * LEVEL_BITS, BITS - level * LEVEL_BITS
        inside = (F.shiftrightunsigned("r.h", above) == F.col("p.prefix")) & (F.col("p.rest") > 0)
        sums = joined(sized, plan.select("source", "prefix", "rest"), inside).groupBy(F.col("r.source").alias("source"), F.shiftrightunsigned("r.h", shift).alias("bucket")).agg(F.sum("r.size").alias("words"))
        up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = sums.select("*", F.sum("words").over(up_to).alias("reached"))
        met = summed.alias("r").join(small(plan.select("source", "rest").alias("p"), n_sources), F.col("r.source").eqNullSafe(F.col("p.source")))
        edge = met.where(F.col("r.reached") > F.col("p.rest")).groupBy(F.col("r.source").alias("source")).agg(F.min("r.bucket").alias("bucket"), F.min_by(F.col("r.reached") - F.col("r.words"), "r.bucket").alias("spent"))
        refined = plan.alias("r").join(small(edge.alias("p"), n_sources), F.col("r.source").eqNullSafe(F.col("p.source")), "left")
        # without an edge the budget takes all of the bucket: the threshold is its end
        end = F.shiftleft(F.col("r.prefix") + F.when(F.col("r.rest") > 0, 1).otherwise(0), LEVEL_BITS)
        plan = cut(refined.select("r.source", "r.source_size", "r.weight", "r.target", "r.epochs", (F.col("r.rest") - F.coalesce("p.spent", F.lit(0))).alias("rest"), F.coalesce("p.bucket", end).cast("long").alias("prefix")))
    plan = plan.withColumn("threshold", F.shiftleft("prefix", BITS - levels * LEVEL_BITS)).drop("prefix").withColumn("extra", F.array().cast("array<bigint>"))
    for turn in range(TOP_UPS):
        room = F.col("r.size") < 2 * F.col("p.rest") if turn == TOP_UPS - 1 else F.col("r.size") <= F.col("p.rest")
        wanted = (F.col("r.h") >= F.col("p.threshold")) & (F.col("p.rest") > 0) & (F.col("r.size") > 0) & room & ~F.array_contains("p.extra", F.col("r.h"))
        best = joined(sized, plan.select("source", "threshold", "rest", "extra"), wanted).groupBy(F.col("r.source").alias("source")).agg(F.min(F.struct(F.abs(F.col("r.size") - F.col("p.rest")).alias("off"), F.col("r.h").alias("h"))).alias("best"))
        best = cut(best.select("source", F.col("best.h").alias("h")))
        # rows that repeat share a hash: what it really adds
        adds = joined(sized, best, F.col("r.h") == F.col("p.h")).groupBy(F.col("r.source").alias("source"), F.col("r.h").alias("h")).agg(F.sum("r.size").alias("adds"))
        met = plan.alias("r").join(small(adds.alias("p"), n_sources), F.col("r.source").eqNullSafe(F.col("p.source")), "left")
        nearer = F.coalesce(F.abs(F.col("r.rest") - F.col("p.adds")) < F.abs("r.rest"), F.lit(False))
        plan = cut(met.select("r.source", "r.source_size", "r.weight", "r.target", "r.epochs", F.when(nearer, F.col("r.rest") - F.col("p.adds")).otherwise(F.col("r.rest")).alias("rest"), "r.threshold", F.when(nearer, F.array_append("r.extra", F.col("p.h"))).otherwise(F.col("r.extra")).alias("extra")))
    return plan, n_sources


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: bool = False) -> DataFrame:
    """How often each document is taken: doc_id, size, source_size, target, taken, copies, source.

    Sources in order of code points, null last, weigh 1, 2, 3 and again 1; see ``targets``.
    ``taken`` is ``copies`` times the size, at most 3 times it. Texts without words, null and empty
    ones among them, have size 0 and share their source's thresholds. Null ids are documents like
    others; rows equal in id and text share their fate. An empty table gives no rows. With ``keep``
    the columns of ``docs`` come back, each row as often as it is taken.
    """
    own = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), hash_of(F.col(doc_id), F.col(text)).alias("h")]
    sized = cut(docs.select(*own))
    plan, n_sources = mix_plan(sized)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), own[1], own[2], own[3]) if keep else sized
    met = rows.alias("r").join(small(plan.alias("p"), n_sources), F.col("r.source").eqNullSafe(F.col("p.source")))
    more = (F.col("r.h") < F.col("p.threshold")) | F.array_contains("p.extra", F.col("r.h"))
    copies = (F.col("p.epochs") + F.when(more, 1).otherwise(0)).cast("long")
    if keep:
        times = F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("__copy")
        return met.where(copies > 0).select("r.row", times).select("row.*")
    return met.select("r.doc_id", "r.size", "p.source_size", "p.target", (F.col("r.size") * copies).alias("taken"), copies.alias("copies"), "r.source")

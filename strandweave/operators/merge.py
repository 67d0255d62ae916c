"""Merging alignments: by transitivity over shared taxa, locus by locus, and by union.

Everywhere: columns other than those named do not come back; a row without a taxon is shared with
none and stays; a null row is all gaps in the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import batches as B
from strandweave.functions.residues import GAP
from strandweave.operators.columns import mask_loci
from strandweave.operators.lineage import cut


def _anchors(rows: DataFrame, names: DataFrame, *by: str) -> DataFrame:
    """(*by, col, anchor) of every column: whether a taxon of ``names`` (__shared, each once) has a residue there.

    One pass over the rows, of which those of other taxa give only their length; each task gives its
    own sums, one row per column.
    """
    met = rows.join(names, F.col("taxon") == F.col("__shared"), "left")
    seq = F.when(F.col("__shared").isNotNull(), F.col("seq")).otherwise(F.repeat(F.lit(GAP), F.length("seq")))
    found = B.counts(met.select(*by, seq.alias("seq")), "seq", lambda symbols: symbols != B.GAP, *by)
    return found.select(*by, "col", (F.col("n") > 0).alias("anchor"))


def insertion_columns(aln: DataFrame, shared: DataFrame) -> DataFrame:
    """(col): columns in which no shared taxon has a residue."""
    return _anchors(aln, shared.select(F.col("taxon").alias("__shared")).distinct()).where("not anchor").select("col")


def column_map(mine: DataFrame, hers: DataFrame) -> DataFrame:
    """(side, col, new_col): where each column goes. Between two shared columns stand mine, then hers.

    The taxa of both sides are shared; they must be aligned alike on both. The windows run over
    one row per column (a million columns are 20 MB), not over cells.
    """
    rows = mine.select(F.lit(0).alias("side"), "taxon", "seq").union(hers.select(F.lit(1), "taxon", "seq"))
    names = rows.groupBy(F.col("taxon").alias("__shared")).agg(F.min("side").alias("__a"), F.max("side").alias("__b")).where("__a < __b").select("__shared")
    before = Window.partitionBy("side").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(F.col("anchor").cast("int")).over(before), F.lit(0))
    # anchors before the column; 0 or 1 for a side's insertions, 2 for an anchor
    both = _anchors(rows, names, "side").select("side", "col", n.alias("slot"), F.when(F.col("anchor"), 2).otherwise(F.col("side")).alias("kind"))
    tie = F.when(F.col("kind") == 2, 0).otherwise(F.col("col"))
    return both.select("side", "col", (F.dense_rank().over(Window.orderBy("slot", "kind", tie)) - 1).alias("new_col"))


def transitivity_merge(mine: DataFrame, hers: DataFrame) -> DataFrame:
    """The two alignments as one: all of my rows and those of hers that I lack.

    Without shared taxa the columns of both stand side by side. Rows are not exploded for it: the map,
    one number per column, goes to the tasks, where each row takes its new form by itself. Rows that
    repeat a taxon each stay.
    """
    places = column_map(mine, hers).orderBy("col").collect()
    to = [np.array([r["new_col"] for r in places if r["side"] == k], np.int64) for k in (0, 1)]
    width = max([int(x.max()) + 1 for x in to if len(x)], default=0)
    added = hers.join(mine.select("taxon").distinct(), "taxon", "left_anti")
    moved = [rows.select("taxon", B.udf("string", B.moved(x, width))(F.col("seq")).alias("seq")) for rows, x in zip((mine, added), to, strict=True)]
    return moved[0].union(moved[1])


def merge_all(parts: list[DataFrame]) -> DataFrame:
    """Folds alignments in the given order, cutting the plan after every fourth."""

    def step(acc: tuple[int, DataFrame], part: DataFrame) -> tuple[int, DataFrame]:
        k, merged = acc[0] + 1, transitivity_merge(acc[1], part)
        return k, cut(merged) if k % 4 == 0 else merged

    return reduce(step, parts[1:], (0, parts[0]))[1]


def union_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows; where both have a taxon the right one stays."""
    return left.join(right.select("taxon"), "taxon", "left_anti").unionByName(right)


def locus_widths(loci: DataFrame) -> DataFrame:
    """(locus, width) of each locus's longest row."""
    return loci.groupBy("locus").agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("width"))


def partitions(loci: DataFrame) -> DataFrame:
    """(locus, first, last): columns of each locus in the concatenation, from 1, both included."""
    up_to = Window.orderBy("locus").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return locus_widths(loci).select("locus", (F.sum("width").over(up_to) - F.col("width") + 1).alias("first"), F.sum("width").over(up_to).alias("last"))


def typed_partitions(loci: DataFrame) -> DataFrame:
    """(locus, datatype, first, last, whole) of (locus, taxon, seq, datatype): ``whole`` is the
    datatype of the concatenation, MIXED where loci differ. A locus of two datatypes raises."""
    kinds = loci.groupBy(F.col("locus").alias("__locus")).agg(F.min(F.upper("datatype")).alias("a"), F.max(F.upper("datatype")).alias("z"))
    one = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("more than one datatype in locus "), F.col("__locus").cast("string"))))
    everything = Window.partitionBy()
    met = partitions(loci).join(F.broadcast(kinds.select("__locus", one.alias("datatype"))), F.col("locus").eqNullSafe(F.col("__locus")))
    whole = F.when(F.min("datatype").over(everything) == F.max("datatype").over(everything), F.col("datatype")).otherwise("MIXED")
    return met.select("locus", "datatype", "first", "last", whole.alias("whole"))


def concatenate(loci: DataFrame, least: float | None = None) -> DataFrame:
    """(taxon, seq): each taxon's rows of all loci in order; gaps where it is absent.

    With ``least`` each locus first loses its columns of fewer residues. Loci are few: their widths
    travel with each taxon's rows as one array. Rows shorter than their locus are padded. A taxon
    that a locus holds twice raises, with both names.
    """
    loci = loci if least is None else mask_loci(loci, least)
    widths = locus_widths(loci).agg(F.array_sort(F.collect_list(F.struct("locus", "width"))).alias("__loci"))
    rows = loci.groupBy("taxon").agg(F.collect_list(F.struct("locus", F.coalesce("seq", F.lit("")).alias("seq"))).alias("__of"))

    def part(x: Column) -> Column:
        own = F.filter("__of", lambda y: y["locus"].eqNullSafe(x["locus"]))
        twice = F.raise_error(F.concat(F.lit("taxon "), F.coalesce(F.col("taxon").cast("string"), F.lit("null")), F.lit(" stands twice in locus "), x["locus"].cast("string")))
        return F.when(F.size(own) > 1, twice).otherwise(F.rpad(F.coalesce(F.get(own, 0)["seq"], F.lit("")), x["width"], GAP))

    return rows.crossJoin(F.broadcast(widths)).select("taxon", F.array_join(F.transform("__loci", part), "").alias("seq"))

"""Column statistics, masks and the sparse form of alignments (taxon, seq).

Everywhere: a null row counts as one without symbols and stays null; rows that repeat a taxon are
rows like others; rows shorter than the widest one have no symbol in the columns behind their end;
columns other than taxon and seq do not come back. An empty alignment has no columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import batches as B
from strandweave.functions import residues as R
from strandweave.functions.residues import GAP


def cells(aln: DataFrame, also: str = "") -> DataFrame:
    """(taxon, col, ch) of the residues; columns count from 0. ``also`` names more symbols to leave out."""
    spread = aln.select("taxon", F.posexplode(F.split("seq", "")).alias("col", "ch"))
    return spread.where((F.col("ch") != "") & ~F.col("ch").isin(GAP, *also))


def width(aln: DataFrame) -> DataFrame:
    """(width) of the longest row, one row; 0 where there is none."""
    return aln.agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("width"))


def column_counts(aln: DataFrame, *by: str) -> DataFrame:
    """(*by, col, n) residues of every column, those without any too; by groups of rows if ``by`` is given.

    One pass over the rows, summed within tasks before the shuffle.
    """
    if not by and not aln.isStreaming:
        return B.counts(aln, "seq", lambda symbols: symbols != B.GAP)
    spread = aln.select(*by, F.posexplode(F.split("seq", "")).alias("col", "ch")).where("ch <> ''")
    return spread.groupBy(*by, "col").agg(F.count_if(F.col("ch") != GAP).alias("n"))


def gap_counts(aln: DataFrame) -> DataFrame:
    """(col, gaps) of every column."""
    return B.counts(aln, "seq", lambda symbols: symbols == B.GAP).withColumnRenamed("n", "gaps")


def kept_columns(aln: DataFrame, least: Column | float) -> DataFrame:
    """(col, new_col) of the columns that a mask with at least ``least`` residues leaves: one is
    masked if its count is at most least - 1, so 0 masks none."""
    least = least if isinstance(least, Column) else F.lit(float(least))
    return column_counts(aln).where(F.col("n") > least - 1).select("col", (F.row_number().over(Window.orderBy("col")) - 1).alias("new_col"))


def lower_case_columns(aln: DataFrame) -> DataFrame:
    """(col): columns in which some row has a letter between ``a`` and ``z``, those two not counted."""
    return cells(aln).where("ch > 'a' and ch < 'z'").select("col").distinct()


def mask_columns(aln: DataFrame, kept: DataFrame) -> DataFrame:
    """The alignment with only the columns ``kept`` (col, ...). Rows keep their order of columns, so
    one array of a flag per column is sent to the tasks; nothing is exploded."""
    cols = np.array([r["col"] for r in kept.select("col").collect()], np.int64)
    flags = np.zeros(cols.max(initial=-1) + 1, bool)
    flags[cols] = True
    return aln.select("taxon", B.udf("string", B.masked(flags))(F.col("seq")).alias("seq"))


def mask_sites(aln: DataFrame, least: float) -> DataFrame:
    """Without the columns that have fewer than ``least`` residues; a fractional bound masks counts of at most least - 1."""
    kept = column_counts(aln).where(F.col("n") > float(least) - 1)
    return mask_columns(aln, kept)


def mask_sites_ratio(aln: DataFrame, ratio: float) -> DataFrame:
    """Keeps columns with residues in at least ceil(ratio x rows) rows."""
    n = aln.agg(F.ceil(F.lit(ratio) * F.count("*")).alias("least"))
    return mask_columns(aln, column_counts(aln).crossJoin(F.broadcast(n)).where(F.col("n") > F.col("least") - 1))


def mask_unaligned_sites(aln: DataFrame) -> DataFrame:
    """Without the columns that ``lower_case_columns`` finds."""
    gone = lower_case_columns(aln)
    return mask_columns(aln, column_counts(aln).join(gone, "col", "left_anti"))


def mask_loci(loci: DataFrame, least: float) -> DataFrame:
    """(locus, taxon, seq): each locus without its own columns of fewer than ``least`` residues."""
    counts = column_counts(loci, "locus").where(F.col("n") > float(least) - 1)
    kept = counts.groupBy(F.col("locus").alias("__locus")).agg(R.flags(F.array_sort(F.collect_set("col"))).alias("__kept"))
    met = loci.join(F.broadcast(kept), F.col("locus").eqNullSafe(F.col("__locus")), "left")
    text = F.array_join(F.filter(F.split("seq", ""), lambda ch, i: F.coalesce(F.get("__kept", i), F.lit(False))), "")
    return met.select("locus", "taxon", text.alias("seq"))


def sparse(aln: DataFrame) -> DataFrame:
    """(taxon, residues, pos): symbols other than gaps and missing marks, and their columns."""
    return aln.select("taxon", R.compact_residues(F.col("seq")).alias("residues"), R.residue_places(F.col("seq"), GAP + R.MISSING).alias("pos"))


def dense(rows: DataFrame, columns: int | Column) -> DataFrame:
    """The inverse of ``sparse``, padded to ``columns``."""
    columns = F.lit(columns) if isinstance(columns, int) else columns
    return rows.select("taxon", R.placed(F.col("residues"), F.col("pos"), columns).alias("seq"))


def gap_runs(aln: DataFrame) -> DataFrame:
    """(taxon, first, last) of each run of gaps, both included, from 0; row by row, without a shuffle."""
    return aln.select("taxon", F.inline(R.gap_runs(F.col("seq"))))


def residue_ordinals(aln: DataFrame) -> DataFrame:
    """(taxon, col, ch, ordinal): each residue's place among its row's residues; row by row."""
    found = F.filter(F.transform(F.split("seq", ""), lambda ch, i: F.struct(i.alias("col"), ch.alias("ch"))), lambda x: ~x["ch"].isin(GAP, ""))
    return aln.select("taxon", F.posexplode(found).alias("ordinal", "__at")).select("taxon", "__at.col", "__at.ch", "ordinal")

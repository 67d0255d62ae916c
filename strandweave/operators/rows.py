"""Row operators on alignments: subsets, filters, names, checks and summaries.

Where nothing else is said: rows that repeat a taxon are rows like others and each stays or goes by
itself, rows without a taxon or without a sequence (null) are kept by operators that do not look at
what they lack, and columns other than taxon and seq pass through filters and are left out by
operators that build new rows. Names of their own begin with two underscores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import batches as B
from strandweave.functions import residues as R


def unaligned(aln: DataFrame) -> DataFrame:
    """Rows without gaps; rows that are gaps only, and null ones, go."""
    return aln.select("taxon", R.degap(F.col("seq")).alias("seq")).where("seq <> ''")


def keep_taxa(aln: DataFrame, taxa: DataFrame) -> DataFrame:
    """Rows whose taxon is among ``taxa``; names that no row has are passed over, null matches nothing."""
    return aln.join(taxa.select("taxon"), "taxon", "left_semi")


def drop_taxa(aln: DataFrame, taxa: DataFrame) -> DataFrame:
    """Rows whose taxon is not among ``taxa``; those without a taxon stay."""
    return aln.join(taxa.select("taxon"), "taxon", "left_anti")


def filter_fragments(aln: DataFrame, least: int | None = None, of_columns: float | None = None, of_median: float | None = None) -> DataFrame:
    """Drops rows with fewer residues than ``least``, than a share of the columns (rounded up), or
    than a multiple of the median; the last one given rules. Null rows go, and count nowhere."""
    for share in (of_columns, of_median):
        if share is not None and not 0 <= share <= 1:
            raise ValueError(f"a share is from 0 to 1: {share}")
    n = R.n_residues(F.col("seq"))
    if of_median is not None:
        bound = aln.agg((F.lit(of_median) * F.median(n)).alias("__bound"))
    elif least is not None:
        return aln.where(n >= least)
    elif of_columns is not None:
        bound = aln.agg(F.ceil(F.lit(of_columns) * F.max(F.length("seq"))).cast("double").alias("__bound"))
    else:
        raise ValueError("one of least, of_columns and of_median is needed")
    return aln.crossJoin(F.broadcast(bound)).where(n >= F.col("__bound")).select(*aln.columns)


def rename(aln: DataFrame, names: DataFrame) -> DataFrame:
    """(taxon, seq) under the names of ``names`` (taxon, name); a row without one raises.

    A taxon that ``names`` holds twice gets the least of its names.
    """
    of = names.groupBy(F.col("taxon").alias("__taxon")).agg(F.min("name").alias("__name"))
    met = aln.join(of, F.col("taxon") == F.col("__taxon"), "left")
    known = F.when(F.col("__taxon").isNull(), F.raise_error(F.concat(F.lit("no name for "), F.coalesce(F.col("taxon").cast("string"), F.lit("a row without a taxon"))))).otherwise(F.col("__name"))
    return met.select(known.alias("taxon"), "seq")


def safe_names(names: DataFrame, order: str) -> DataFrame:
    """(name, safe) for distinct names: the sanitised name, with 1, 2, ... appended where several share it.

    First come by ``order``. A number that would make another name's sanitised form is passed over.
    """
    first = names.groupBy("name").agg(F.min(order).alias("__first")).withColumn("base", R.safe_name(F.col("name")))
    bases = first.select("base").distinct()
    digits = F.length(F.regexp_extract("base", "[0-9]+$", 0))
    ends = bases.where(digits > 0).select("base", F.explode(F.sequence(F.lit(1), digits)).alias("d"))
    number = F.right("base", F.col("d"))
    taken = ends.select(F.left("base", F.length("base") - F.col("d")).alias("base"), number.alias("number")).where("number not like '0%' and length(number) < 10")
    taken = taken.groupBy("base").agg(F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("taken"))
    place = (F.row_number().over(Window.partitionBy("base").orderBy("__first", "name")) - 1).alias("place")
    met = first.select("name", "base", place).join(taken, "base", "left")
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("place"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return met.select("name", F.when(F.col("place") == 0, F.col("base")).otherwise(F.concat("base", free.cast("string"))).alias("safe"))


def shared_safe_names(loci: DataFrame) -> DataFrame:
    """(name, safe, loci) over all loci of (locus, taxon): a name has one safe form wherever it
    stands; first come by locus, then name. A name that one locus holds twice raises."""
    held = loci.groupBy("taxon", "locus").agg(F.count("*").alias("n"))
    once = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("a locus holds twice the name "), F.col("taxon").cast("string")))).otherwise(F.col("locus"))
    of = held.select(F.col("taxon").alias("name"), once.alias("locus")).groupBy("name").agg(F.array_sort(F.collect_set("locus")).alias("loci"))
    safe = safe_names(loci.select(F.col("taxon").alias("name"), "locus"), "locus")
    return safe.join(of, "name").select("name", "safe", "loci")


def relabel_loci(loci: DataFrame, names: DataFrame, back: bool = False) -> DataFrame:
    """(locus, taxon, seq) under the safe names of ``names`` (name, safe), or back under the real ones; an unknown one raises."""
    old, new = ("safe", "name") if back else ("name", "safe")
    of = names.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    met = loci.join(of, F.col("taxon") == F.col("__old"), "left")
    known = F.when(F.col("__old").isNull(), F.raise_error(F.concat(F.lit("no name for "), F.col("taxon").cast("string")))).otherwise(F.col("__new"))
    return met.select("locus", known.alias("taxon"), "seq")


def nice_filename(name):
    """Without the symbols that file names should not have: letters, digits, ``-``, ``_`` and ``.`` stay."""
    return F.regexp_replace(name, "[^-_a-zA-Z0-9.]", "")


def duplicate_names(aln: DataFrame) -> DataFrame:
    """(taxon, n) of the taxa that more than one row has; null is a name here."""
    return aln.groupBy("taxon").agg(F.count("*").alias("n")).where("n > 1")


def alphabet_violations(aln: DataFrame, datatype: str) -> DataFrame:
    """The rows with a symbol outside the alphabet of ``datatype``, in either case; null rows have none."""
    return aln.where(~R.in_alphabet(F.col("seq"), datatype))


def summary(loci: DataFrame) -> DataFrame:
    """Per locus of (locus, taxon, seq): taxa, longest row, whether all rows are as long."""
    return loci.groupBy("locus").agg(
        F.count_distinct("taxon").alias("n_taxa"),
        F.max(F.length("seq")).alias("longest"),
        (F.min(F.length("seq")) == F.max(F.length("seq"))).alias("aligned"),
        F.max(R.n_residues(F.col("seq"))).alias("most_residues"),
    )


def summary_of_all(loci: DataFrame) -> DataFrame:
    """(n_loci, n_taxa, longest) over all loci, one row; a taxon of several loci counts once."""
    return loci.agg(F.count_distinct("locus").alias("n_loci"), F.count_distinct("taxon").alias("n_taxa"), F.max(F.length("seq")).alias("longest"))


def pad(aln: DataFrame) -> DataFrame:
    """Rows padded with gaps to the longest one."""
    longest = aln.agg(F.max(F.length("seq")).alias("__width"))
    return aln.crossJoin(F.broadcast(longest)).select("taxon", F.rpad("seq", F.col("__width"), F.lit(R.GAP)).alias("seq"))


def stride(aln: DataFrame, most_chunks: int, per_chunk: int = 50) -> DataFrame:
    """(taxon, chunk): rows dealt in turn, in order of taxon, to min(most_chunks, ceil(n / per_chunk)) chunks.

    Ranks come from range partitions and their sizes, so no task sees all rows.
    """
    from strandweave.operators.ranks import global_rank

    n = aln.count()
    chunks = max(1, min(most_chunks, -(-n // per_chunk)))
    return global_rank(aln.select("taxon"), "taxon").select("taxon", F.pmod(F.col("rank"), F.lit(chunks)).cast("int").alias("chunk"))


def sample(aln: DataFrame, most: int) -> DataFrame:
    """``most`` rows of the lowest digests of their names: the same ones in every run."""
    return aln.orderBy(F.md5(F.col("taxon").cast("string").cast("binary")), "taxon").limit(most)


def consensus(loci: DataFrame) -> DataFrame:
    """(locus, seq): the most frequent residue of each column, the smaller one in a tie; gaps where none is."""
    counted = B.tallies(loci, "locus", "seq")
    residue = F.when(F.col("ch") != R.GAP, F.struct((-F.col("n")).alias("m"), F.col("ch").alias("ch")))
    best = counted.groupBy("locus", "col").agg(F.coalesce(F.min(residue)["ch"], F.lit(R.GAP)).alias("ch"))
    rows = best.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("col", "ch"))).alias("cells"))
    return rows.select("locus", F.array_join(F.col("cells.ch"), "").alias("seq"))


def distances(rows: DataFrame, key: str = "locus") -> DataFrame:
    """(a, b, distance) for each pair a < b of a few rows, such as one consensus per group."""
    a, b = rows.select(F.col(key).alias("a"), F.col("seq").alias("x")), rows.select(F.col(key).alias("b"), F.col("seq").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", R.p_distance(F.col("x"), F.col("y")).alias("distance"))


def replaced(aln: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """The alignment with ``old`` as ``new``, and (taxon, ordinals) of what was replaced: its places among the row's residues."""
    places = aln.select("taxon", B.udf("array<int>", B.ordinals(old))(F.col("seq")).alias("ordinals"))
    return aln.select("taxon", F.translate("seq", old, new).alias("seq")), places


def restored(aln: DataFrame, places: DataFrame, symbol: str, *also: str) -> DataFrame:
    """(taxon, seq, *also): puts ``symbol`` at the residues of those ordinals, wherever gaps now stand between them.

    ``places`` has (taxon, ordinals), or (taxon, ordinal) one by one. Each row is gone through once.
    Ordinals beyond a row's residues are passed over; rows that repeat a taxon share its ordinals.
    """
    own = "ordinals" if "ordinals" in places.columns else F.array("ordinal").alias("ordinals")
    of = places.select("taxon", own).groupBy(F.col("taxon").alias("__taxon")).agg(F.flatten(F.collect_list("ordinals")).alias("__hit"))
    met = aln.join(of, F.col("taxon") == F.col("__taxon"), "left")
    text = B.udf("string", B.restored(symbol))(F.col("seq"), F.coalesce("__hit", F.array().cast("array<int>")))
    return met.select("taxon", text.alias("seq"), *also)


def joined_places(parts: list[DataFrame]) -> DataFrame:
    """(taxon, ordinal) of several alignments whose rows are put together: the union, each place once."""
    each = [p.select("taxon", F.explode("ordinals").alias("ordinal") if "ordinals" in p.columns else "ordinal") for p in parts]
    return reduce(DataFrame.union, each).distinct()

"""Sequence files as DataFrames: FASTA, COMPACT, COMPACT3 and Stockholm read, these, COMPACT2 and
relaxed PHYLIP written, by Spark's text source.

Readers give one row per record, in no order; a name that two records have is two rows (see
``rows.duplicate_names``). Empty files have no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import batches as B
from strandweave.functions.residues import ALPHABETS, GAP, degap, in_alphabet, inline_gap_counts, is_legal, missing_policy, once, placed
from strandweave.operators.columns import sparse


def fasta_line(taxon: str = "taxon", seq: str = "seq") -> Column:
    return F.concat(F.lit(">"), F.col(taxon).cast("string"), F.lit("\n"), F.col(seq))


def records_of(raw: DataFrame) -> DataFrame:
    """(taxon, lines) of (value): the name in the first line of each record, with or without its ``>``, and the other lines."""
    body = F.regexp_replace(F.regexp_replace("__value", "^>", ""), "\r\n?", "\n")
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    # a filter on what Python has written would be put before it, with a pass of its own
    split = raw.select(once(__value=F.col("value"))).where("trim(__value) <> ''").select(once(__lines=lines))
    return split.select(once(taxon=F.get("__lines", 0), lines=F.filter("__lines", lambda x, i: (i > 0) & (x != ""))))


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(taxon, lines): one row per record of files of ``>`` records, splittable between them.

    Text before a file's first ``>`` raises. Records are split at line ends before ``>``, so only a
    file's first one still has it: a file in which none has it begins with something else.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    begun = F.bool_or(F.col("value").startswith(">") | (F.trim("value") == ""))
    stray = raw.groupBy(F.col("_metadata.file_path").alias("__file")).agg(begun.alias("__ok")).where("not __ok").agg(F.min("__file").alias("__stray"))
    value = F.when(F.col("__stray").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("text before the first record of "), F.col("__stray"))))
    return records_of(raw.crossJoin(F.broadcast(stray)).select(value.alias("value")))


def fasta_rows(records: DataFrame, upper: bool = True, datatype: str | None = None) -> DataFrame:
    """(taxon, seq) of (taxon, lines). Records without a name and illegal symbols raise; white space
    inside rows goes. With ``datatype`` its alphabet holds, and a record without residues raises."""
    rows = records.select("taxon", F.regexp_replace(F.array_join("lines", ""), r"\s", "").alias("seq"))
    named = F.when(F.col("taxon") == "", F.raise_error(F.lit("a record has no name"))).otherwise(F.col("taxon"))
    seq = F.col("seq")
    if datatype and datatype.upper() not in ALPHABETS:
        raise ValueError(f"no such datatype: {datatype}")
    fits = in_alphabet(seq, datatype) if datatype else is_legal(seq)
    legal = F.when(fits, F.upper(seq) if upper else seq).otherwise(F.raise_error(F.concat(F.lit("illegal symbol in "), F.col("taxon"))))
    if datatype:
        legal = F.when(seq == "", F.raise_error(F.concat(F.lit("no residues follow the name "), F.col("taxon")))).otherwise(legal)
    return rows.select(named.alias("taxon"), legal.alias("seq"))


def read_fasta(spark: SparkSession, path: str | list[str], upper: bool = True, datatype: str | None = None) -> DataFrame:
    """(taxon, seq) of FASTA files; see ``fasta_rows``."""
    return fasta_rows(read_records(spark, path), upper, datatype)


def write_fasta(aln: DataFrame, path: str, compression: str = "none") -> None:
    aln.select(fasta_line()).write.option("compression", compression).text(path)


def write_unaligned_fasta(aln: DataFrame, path: str, compression: str = "none") -> None:
    """Rows without gaps; empty ones are left out."""
    rows = aln.select("taxon", degap(F.col("seq")).alias("seq")).where("seq <> ''")
    write_fasta(rows, path, compression)


def compact3_rows(aln: DataFrame) -> DataFrame:
    """(taxon, residues, runs): the residues, and each run of gaps as ``first-last``, from 0."""
    # one pass for both, so that no worker more takes each row
    both = B.udf("struct<residues:string,runs:string>", B.compacted)(F.col("seq"))
    return aln.select("taxon", both.alias("__both")).select("taxon", "__both.residues", "__both.runs")


def compact3_line() -> Column:
    return F.concat(F.lit(">"), F.col("taxon").cast("string"), F.lit("\n"), F.col("residues"), F.lit("\n@ "), F.col("runs"))


def write_compact3(aln: DataFrame, path: str, compression: str = "none") -> None:
    compact3_rows(aln).select(compact3_line()).write.option("compression", compression).text(path)


def read_compact3(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(taxon, seq) of COMPACT3 files; see ``compact3_decoded``."""
    return compact3_decoded(read_records(spark, path))


def compact3_decoded(records: DataFrame) -> DataFrame:
    """(taxon, seq) of (taxon, lines); lines that begin with ``#`` are passed over, gaps inside residues raise."""
    rows = records.select("taxon", F.filter("lines", lambda x: ~x.startswith("#")).alias("lines"))
    residues = F.array_join(F.filter("lines", lambda x: ~x.startswith("@")), "")
    runs = F.array_join(F.transform(F.filter("lines", lambda x: x.startswith("@")), lambda x: F.substring(x, 2, 1 << 30)), " ")
    checked = F.when(residues.contains(GAP), F.raise_error(F.concat(F.lit("gaps among the residues of "), F.col("taxon")))).otherwise(residues)
    found = rows.select("taxon", once(residues=checked, runs=runs))
    return found.select("taxon", B.udf("string", B.spread)(F.col("residues"), F.col("runs")).alias("seq"))


def phylip_lines(aln: DataFrame) -> DataFrame:
    """(place, line): a header of rows and columns, then ``name sequence`` in order of name.

    Ragged rows and names with white space raise.
    """
    size = aln.agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("a"), F.max(F.length("seq")).alias("b"))
    even = F.when(F.col("a") == F.col("b"), F.concat_ws("\t", "n", "b")).otherwise(F.raise_error(F.lit("the rows differ in length")))
    name = F.col("taxon").cast("string")
    fit = F.when(name.rlike(r"\s"), F.raise_error(F.concat(F.lit("white space in the name "), name))).otherwise(name)
    return size.select(F.lit("").alias("place"), even.alias("line")).union(aln.select(name, F.concat_ws(" ", fit, "seq")))


def write_phylip(aln: DataFrame, path: str, compression: str = "none") -> None:
    phylip_lines(aln).orderBy("place").select("line").write.option("compression", compression).text(path)


def compact_line(residues: str = "residues", pos: str = "pos") -> Column:
    """Residues, a line ``<`` and their columns, from the sparse form: what ``compact_decoded`` reads."""
    return F.concat(F.lit(">"), F.col("taxon").cast("string"), F.lit("\n"), F.col(residues), F.lit("\n<\n"), F.array_join(F.col(pos).cast("array<string>"), " "))


def compact_decoded(records: DataFrame) -> DataFrame:
    """(taxon, residues, pos) of (taxon, lines): residues, then behind a line ``<`` their columns.

    A record with another number of columns than residues, without a name or with an illegal symbol raises.
    """
    mark = F.array_position(F.transform("lines", lambda x: x.startswith("<")), True)
    upto = F.when(mark > 0, mark - 1).otherwise(F.size("lines")).cast("int")
    residues = F.upper(F.regexp_replace(F.array_join(F.slice("lines", F.lit(1), upto), ""), r"\s", ""))
    after = F.filter("lines", lambda x, i: (mark > 0) & (i >= mark))
    rows = records.select("taxon", once(residues=residues, after=F.array_join(after, " ")))
    rows = rows.select("taxon", "residues", B.udf("array<int>", B.numbers)(F.col("after")).alias("pos"))
    wrong = F.when(F.col("taxon") == "", "a record has no name").when(~is_legal(F.col("residues")), "illegal symbol").when(F.length("residues") != F.size("pos"), "columns do not match residues")
    checked = F.when(wrong.isNull(), F.col("residues")).otherwise(F.raise_error(F.concat_ws(": ", wrong, "taxon")))
    return rows.select("taxon", checked.alias("residues"), "pos")


def read_compact(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(taxon, residues, pos) of COMPACT files."""
    return compact_decoded(read_records(spark, path))


def _text_writer(lines):
    def write_lines(aln: DataFrame, path: str, compression: str = "none") -> None:
        lines(aln).write.option("compression", compression).text(path)

    return write_lines


write_compact = _text_writer(lambda aln: sparse(aln).select(compact_line()))
write_compact2 = _text_writer(lambda aln: sparse(aln).select(compact2_line()))
write_inline_compact = _text_writer(lambda aln: aln.select("taxon", inline_gap_counts(F.col("seq")).alias("seq")).select(fasta_line()))


def stockholm_rows(files: DataFrame) -> DataFrame:
    """(file, taxon, seq, insertions) of (file, text), one Stockholm alignment a row; see ``stockholm_lines``."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    return stockholm_lines(files.select("file", F.posexplode(lines).alias("at", "line")))


def stockholm_lines(lines: DataFrame) -> DataFrame:
    """(file, taxon, seq, insertions) of (file, at, line), the lines of Stockholm alignments, ``at`` in their order.

    Blocks of ``name sequence`` lines up to ``//`` are joined by name in order of lines; blank lines
    and those that begin with ``#`` are passed over, ``.`` becomes a gap. ``insertions``: the columns
    in which the first sequence has a lower-case letter, ``*`` or ``.``. Other lines raise. No file is
    held by one task: a row is what is put together.
    """
    rows = lines.select("file", "at", F.trim("line").alias("line")).where("line <> '' and not line like '#%'")
    ends = rows.where("line = '//'").groupBy(F.col("file").alias("__file")).agg(F.min("at").alias("__end"))
    used = rows.join(ends, F.col("file").eqNullSafe(F.col("__file")), "left").where("__end is null or at < __end")
    parts = F.split("line", r"\s+")
    fit = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("no name and sequence: "), F.col("line"))))
    named = used.select("file", "at", fit.alias("p")).select("file", "at", F.get("p", 0).alias("taxon"), F.get("p", 1).alias("part"))
    whole = named.groupBy("file", "taxon").agg(F.min("at").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("raw"))
    top = whole.groupBy(F.col("file").alias("__file")).agg(F.min_by("raw", "first").alias("__top"))
    odd = F.filter(F.transform(F.split("__top", ""), lambda ch, i: F.when(ch.rlike("[a-z*.]"), i)), lambda i: i.isNotNull())
    return whole.join(top, F.col("file").eqNullSafe(F.col("__file"))).select("file", "taxon", F.translate("raw", ".", GAP).alias("seq"), odd.alias("insertions"))


def read_stockholm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, taxon, seq, insertions) of Stockholm files, each of which fits a row."""
    raw = spark.read.text(path, wholetext=True)
    return stockholm_rows(raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def compact2_line(residues: str = "residues", pos: str = "pos") -> Column:
    """Residues and their columns, from the sparse form."""
    return F.concat(F.lit(">"), F.col("taxon").cast("string"), F.lit("\n+"), F.col(residues), F.lit("\n@"), F.array_join(F.col(pos).cast("array<string>"), " "))


def partition_line(model: str = "model") -> Column:
    """``KEY, pN=first-last`` for (place, model, first, last); a protein's key is its model without prefix."""
    key = F.regexp_replace(F.col(model), "^PROT(GAMMAI?|CATI?)", "")
    return F.concat(key, F.lit(", p"), F.col("place").cast("string"), F.lit("="), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))


def name_map_line() -> Column:
    """Two lines and an empty one for each (safe, name)."""
    return F.concat_ws("\n", "safe", "name", F.lit(""))


def taxa(aln: DataFrame) -> DataFrame:
    """(taxon) in order, repeated ones as often as they stand there."""
    return aln.select("taxon").orderBy("taxon")


def _compact_alignment(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(taxon, seq) of COMPACT files, as wide as their last column."""
    rows = read_compact(spark, path)
    width = rows.agg((F.coalesce(F.max(F.array_max("pos")), F.lit(-1)) + 1).alias("__width"))
    return rows.crossJoin(F.broadcast(width)).select("taxon", placed(F.col("residues"), F.col("pos"), F.col("__width")).alias("seq"))


def _stockholm_alignment(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_stockholm(spark, path).select("taxon", "seq")


READERS = {"fasta": read_fasta, "compact": _compact_alignment, "compact3": read_compact3, "stockholm": _stockholm_alignment}


def reader(kind: str):
    """The reader of (taxon, seq) in a format by name, in any case; formats that have none raise."""
    if kind.lower() not in READERS:
        raise ValueError(f"no reader for {kind}")
    return READERS[kind.lower()]


WRITERS = {"fasta": write_fasta, "unaligned": write_unaligned_fasta, "compact": write_compact, "compact2": write_compact2, "compact3": write_compact3, "inline": write_inline_compact, "phylip": write_phylip}


def write(aln: DataFrame, path: str, kind: str = "fasta", compression: str = "none") -> None:
    """Writes (taxon, seq) in a format by name, ``compression`` none or gzip; an unknown name raises."""
    if kind.lower() not in WRITERS:
        raise ValueError(f"no writer for {kind}")
    WRITERS[kind.lower()](aln, path, compression)


def locus_paths(spark: SparkSession, folder: str) -> list[str]:
    """The ``.fas`` and ``.fasta`` files of a folder in order of name; none, or no folder, raises."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"no such folder: {folder}")
    names = sorted(str(x.getPath()) for x in fs.listStatus(path) if x.isFile() and str(x.getPath()).endswith((".fas", ".fasta")))
    if not names:
        raise ValueError(f"no .fas or .fasta files in {folder}")
    return names


def read_loci(spark: SparkSession, paths: list[str] | str, kind: str = "fasta", datatype: str | None = None, missing: str | None = None) -> DataFrame:
    """(locus, taxon, seq): one locus per file, numbered in the order given; a folder's files in order of name.

    With ``datatype``, which then is a column too, its alphabet holds and missing marks are deleted (``missing`` absent, the
    default) or become the symbol for any residue (ambiguous).
    """
    paths = locus_paths(spark, paths) if isinstance(paths, str) else paths
    if not paths:
        raise ValueError("no files")
    out = None
    for k, p in enumerate(paths):
        rows = reader(kind)(spark, p, datatype=datatype) if kind.lower() == "fasta" else reader(kind)(spark, p)
        seq = missing_policy(F.col("seq"), missing or "absent", datatype) if datatype else F.col("seq")
        rows = rows.select(F.lit(k).alias("locus"), "taxon", seq.alias("seq"), *([F.lit(datatype.upper()).alias("datatype")] if datatype else []))
        out = rows if out is None else out.unionByName(rows)
    return out

"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators between words: space and \x09-\x0D, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts are thousands of bytes each, and a worker holds a few batches at once.
BATCH_ROWS = 2_000
#: A batch of rows as Spark hands it to a task and takes it back.
Batches = Iterator[pa.RecordBatch]


def _memory_given_back() -> Callable[[], None]:
    """A function that returns what this process has freed to the system."""
    try:
        trim = ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return pa.default_memory_pool().release_unused

    def give() -> None:
        pa.default_memory_pool().release_unused()
        trim(0)

    return give


_give: list[Callable[[], None]] = []
_kept: dict[str, object] = {}


def keep(key: str, make: Callable[[], object]) -> object:
    """What a scan of this worker has made under ``key``, or now makes; a worker keeps one such thing."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def lean(scan: Callable[[Batches], Batches], keeps: bool = False) -> Callable[[Batches], Batches]:
    """``scan`` as a task that leaves a worker small: workers serve stage after stage.

    Unless it ``keeps`` something itself, what other scans have kept goes before it begins. Freed
    memory returns to the system when it ends.
    """

    @wraps(scan)
    def run(batches: Batches) -> Batches:
        if not _give:
            _give.append(_memory_given_back())
        if not keeps and _kept:
            _kept.clear()
            gc.collect()
        try:
            yield from scan(batches)
        finally:
            _give[0]()

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the one the application has set.

    Only on a local master, where all tasks share the machine, is one made; elsewhere its lack raises.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate data, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    spark = df.sparkSession
    shared_folder(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, min(int(was), BATCH_ROWS) if int(was) > 0 else BATCH_ROWS)
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(key, was)


def settled(df: DataFrame, per_part: int = 10_000) -> tuple[DataFrame, int]:
    """``cut(df)`` and its number of rows, counted on the way, in no more partitions than they fill."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return out.coalesce(n // per_part + 1), n


def salts(n_rows: int, per_salt: int = 100_000, least: int = 16) -> int:
    """How many salts spread ``n_rows``: it grows with the input and reruns agree."""
    return max(least, -(-n_rows // per_salt))


def salted_rank(df: DataFrame, keys: list[str], order: list[str], salt_on: list[str], n_rows: int, name: str = "rank") -> DataFrame:
    """Adds a gapless 0-based rank of each row within ``keys`` without gathering a key's rows.

    Rows of a key are dealt to salts by a hash of ``salt_on``; each salt's rows are numbered by
    themselves and shifted by the number of rows in the key's lower salts. Rows that agree in
    ``salt_on`` (repeats) share a salt.
    """
    n = salts(n_rows)
    rows = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(n)))
    counts = rows.groupBy(*keys, "__salt").agg(F.count("*").alias("__n"))
    below = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "__salt", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__shift"))
    own = Window.partitionBy(*keys, "__salt").orderBy(*order)
    numbered = rows.withColumn("__own", F.row_number().over(own) - 1)
    on = [numbered[c].eqNullSafe(shifts[c]) for c in [*keys, "__salt"]]
    return numbered.join(shifts, on, "left").select(*[numbered[c] for c in df.columns], (numbered["__own"] + shifts["__shift"]).cast("long").alias(name))


def small(df: DataFrame, n_rows: int, most: int = 200_000) -> DataFrame:
    """Hints a broadcast for a side whose counted rows are few; beyond that the join shuffles."""
    return F.broadcast(df) if n_rows <= most else df


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_score(docs: DataFrame, text: str, scorer, name: str) -> DataFrame:
    """Adds ``name``, a double that ``scorer(column)`` gives for each row's text; other columns pass through.

    ``scorer`` is called once per Arrow batch with its text column and returns an array; one that
    uses ``keep`` has an attribute ``keeps``.
    """
    at = docs.columns.index(text)

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer(batch.column(at)), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(lean(scan, keeps=getattr(scorer, "keeps", False)), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, y) of the rows that a model may learn from: labelled, present, and not held out.

    An id with several labels counts as 1 if any of them is 1.
    """
    marks = labels.where(F.col(label).isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    return marks.join(docs.select(F.col(doc_id).cast("long").alias("doc_id")), "doc_id", "left_semi")

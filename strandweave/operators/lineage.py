"""Cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame


def shared_folder(sc: SparkContext) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the one the application has set.

    Only on a local master, where all tasks share the machine, is one made; elsewhere its lack raises.
    """
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, for tables that a loop joins again and again.

    A checkpoint keeps its plan's guess of its size, and a join multiplies its sides' guesses: with ``cut``
    alone the guess has several times the digits after each round, until planning takes minutes. Files have a size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark.sparkContext)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``stored`` has given and that no plan reads any more.

    The driver is asked to collect its garbage, so that Spark deletes the shuffle files of finished jobs too: a
    loop over large tables would else keep all that it has ever written.
    """
    for df in tables:
        spark = df.sparkSession
        for name in {file.split("/")[-2] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark.sparkContext), name)
            if name.startswith("stored-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()

"""Column residue counts kept up to date while aligned rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandweave.operators.columns import cells


def running_counts(rows: DataFrame) -> DataFrame:
    """(col, n, last) of a stream of (taxon, seq): residues so far and the last taxon that had one.

    The state is one row per column, whatever the number of rows.
    """
    return cells(rows).groupBy("col").agg(F.count("*").alias("n"), F.max("taxon").alias("last"))


def start(rows: DataFrame, checkpoint: str, sink: str = "memory", name: str = "column_counts") -> StreamingQuery:
    return running_counts(rows).writeStream.outputMode("complete").format(sink).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

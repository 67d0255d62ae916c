"""The loop: align by the tree, build a tree, score it, keep or drop the result, and again.

Each iteration is a partition of three tables in a folder: alignments, trees and scores. The score
is written last, so an iteration with a score is complete. What is complete is never written again; what
a lost driver left unfinished is replaced. Called again with the same folder, the loop goes on behind the
last complete iteration.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.control import Blind, Limits, accept_blindly, stop_reason
from strandweave.operators import columns as C
from strandweave.operators import trees as T
from strandweave.operators.builders import neighbour_joining
from strandweave.operators.fold import align_by_tree, from_unaligned
from strandweave.operators.lineage import cut
from strandweave.operators.likelihood import log_likelihoods

_SCORES = "iteration int, score double, accepted boolean, improved boolean, blind boolean, seconds double"


def _complete(spark: SparkSession, folder: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/scores")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return spark.read.schema(_SCORES).parquet(f"{folder}/scores").orderBy("iteration").collect()


def _written(df: DataFrame, folder: str, table: str, iteration: int) -> DataFrame:
    """One iteration's partition; leftovers of one that was never complete go."""
    path = f"{folder}/{table}/iteration={iteration}"
    df.write.mode("errorifexists" if table == "scores" else "overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _realigned(seqs: DataFrame, tree: DataFrame, most: int) -> DataFrame:
    """(taxon, seq): all rows aligned by the tree, whose leaves bear the taxa as labels."""
    leaves = tree.where("is_leaf").select(F.col("node").alias("leaf"), "label")
    named = cut(seqs.join(leaves, F.col("taxon").cast("string") == F.col("label")).select(F.col("leaf").alias("taxon"), "seq", F.col("taxon").alias("__taxon")))
    shape = cut(tree.select("node", "parent", "len", "is_leaf"))
    rows = align_by_tree(shape, T.ancestors(shape), named.select("taxon", "seq"), most, "mincluster")
    back = named.select(F.col("taxon").alias("__leaf"), "__taxon")
    return rows.join(back, F.col("taxon") == F.col("__leaf")).select(F.col("__taxon").alias("taxon"), "seq")


def iterate(
    seqs: DataFrame,
    folder: str,
    limits: Limits | None = None,
    blind: Blind | None = None,
    most: int = 200,
    least_residues: int = 1,
    now: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """(iteration, score, accepted, improved, blind, seconds) of all iterations of ragged (taxon, seq) rows.

    Iteration 0 is ``from_unaligned``. Each later one aligns the rows by the tree kept last, masks columns of
    fewer than ``least_residues`` residues, and builds and scores a tree; ``control`` decides what is kept
    and when to stop. Taxa are unlike each other, and no more than a neighbour joining takes (500).
    """
    limits, blind, spark = limits or Limits(iterations=3), blind or Blind(), seqs.sparkSession
    rows = cut(seqs.select("taxon", "seq"))
    began, done = now(), _complete(spark, folder)
    k = done[-1]["iteration"] + 1 if done else 0
    kept = max((r["iteration"] for r in done if r["accepted"]), default=None)
    best = max((r["score"] for r in done if r["accepted"]), default=None)
    improved = max((r["iteration"] for r in done if r["improved"]), default=0)
    since = min((r["iteration"] for r in done if r["blind"]), default=None)
    improved_at = next((r["seconds"] for r in done if r["iteration"] == improved), 0.0)
    blind_at = next((r["seconds"] for r in done if r["blind"]), None)
    spent = done[-1]["seconds"] if done else 0.0
    while True:
        passed = spent + now() - began
        if k and stop_reason(limits, k - 1, improved, since, passed, improved_at, blind_at):
            break
        if k:
            tree = spark.read.parquet(f"{folder}/trees/iteration={kept}")
            aln = _realigned(rows, tree, most)
        else:
            aln = from_unaligned(rows)
        aln = _written(aln, folder, "alignments", k)
        masked = cut(C.mask_sites(aln, least_residues).select(F.lit(0).alias("subset"), "taxon", "seq"))
        tree = _written(neighbour_joining(masked, correct=True).drop("subset"), folder, "trees", k)
        score = log_likelihoods(masked, tree.withColumn("subset", F.lit(0))).first()["score"]
        passed = spent + now() - began
        better = best is None or score > best
        taken = accept_blindly(blind, score, best, k, k - improved, passed, improved_at, since is not None)
        row = (k, float(score), better or taken, better, taken and not better, passed)
        _written(spark.createDataFrame([row], _SCORES).coalesce(1), folder, "scores", k)
        if better:
            best, improved, improved_at = score, k, passed
        if taken and not better and since is None:
            since, blind_at = k, passed
        kept = k if better or taken else kept
        k += 1
    return spark.read.schema(_SCORES).parquet(f"{folder}/scores").orderBy("iteration")


def best_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The alignment and the tree of the complete iteration with the highest score, the first of equal ones."""
    done = _complete(spark, folder)
    if not done:
        raise ValueError(f"no complete iteration in {folder}")
    k = min(done, key=lambda r: (-r["score"], r["iteration"]))["iteration"]
    return spark.read.parquet(f"{folder}/alignments/iteration={k}"), spark.read.parquet(f"{folder}/trees/iteration={k}")

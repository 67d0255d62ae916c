"""The likelihood of trees: distinct column patterns, and Felsenstein's pruning over them.

An alignment's columns become patterns, one symbol a leaf, counted once each however often they occur; a
task prunes a batch of patterns up the tree at once. The model is Jukes and Cantor's: all changes between
A, C, G and T are equally likely, and a branch's length is its expected number of changes a site.
Other symbols and gaps tell nothing; U is T; lower case is upper case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import residues as R
from strandweave.functions.residues import GAP

STATES = "ACGT"
#: Shorter branches count as this, as no two different rows could stand at their ends.
LEAST_LENGTH = 1e-6


def patterns(aln: DataFrame) -> DataFrame:
    """(subset, pattern, n): the columns of (subset, leaf, seq), symbols in order of leaf, and how often each
    one occurs. Short and null rows end in gaps. A pattern is as long as a subset has leaves, which is bounded
    by its decomposition."""
    sized = aln.groupBy(F.col("subset").alias("__subset")).agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("__width"))
    met = aln.join(sized, F.col("subset").eqNullSafe(F.col("__subset"))).select("subset", "leaf", F.rpad(F.coalesce("seq", F.lit("")), F.col("__width"), GAP).alias("seq"))
    cells = met.select("subset", "leaf", F.posexplode(R.symbols(F.translate(F.upper("seq"), "U", "T"))).alias("col", "ch"))
    columns = cells.groupBy("subset", "col").agg(F.array_sort(F.collect_list(F.struct("leaf", "ch"))).alias("x"))
    return columns.groupBy("subset", F.array_join(F.col("x.ch"), "").alias("pattern")).agg(F.count("*").alias("n"))


def pruned(texts: list[str], nodes: list[tuple[int, int | None, float | None]]) -> np.ndarray:
    """The log likelihood of each pattern on the tree of (node, parent, len); leaves are the first nodes, in order."""
    n_leaves = len(texts[0]) if texts else 0
    codes = np.array([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]).reshape(len(texts), n_leaves)
    below: dict[int, np.ndarray] = {}
    logs = np.zeros(len(texts))
    kids: dict[int | None, list[tuple[int, float]]] = {}
    for node, parent, length in nodes:
        kids.setdefault(parent, []).append((node, max(LEAST_LENGTH, length or 0.0)))
    order = [kids[None][0][0]]
    for node in order:
        order += [k for k, _ in kids.get(node, [])]
    for node in reversed(order):
        if node not in kids:
            own = np.ones((len(texts), len(STATES)))
            known = np.isin(codes[:, node], [ord(s) for s in STATES])
            own[known] = codes[known, node][:, None] == [ord(s) for s in STATES]
        else:
            own = np.ones((len(texts), len(STATES)))
            for kid, length in kids[node]:
                stays = np.exp(-4 / 3 * length)
                part = below.pop(kid)
                own = own * (stays * part + (1 - stays) / 4 * part.sum(axis=1, keepdims=True))
            most = own.max(axis=1, keepdims=True)
            logs += np.log(most[:, 0])
            own = own / most
        below[node] = own
    return logs + np.log(below[order[0]].mean(axis=1))


def log_likelihoods(aln: DataFrame, trees: DataFrame) -> DataFrame:
    """(subset, score): the log likelihood of each subset's rows (subset, taxon, seq) on its tree of ``trees``
    (subset, node, parent, len, label, is_leaf), whose leaves bear the taxa and are numbered from 0.

    Rows whose taxon is no leaf, and leaves without a row, raise. Null lengths are the least one. A subset
    without columns scores 0; one without a tree does not come back.
    """
    named = trees.where("is_leaf").select(F.col("subset").alias("__subset"), F.col("label").alias("__label"), F.col("node").alias("leaf"))
    same = F.col("subset").eqNullSafe(F.col("__subset")) & (F.col("taxon").cast("string") == F.col("__label"))
    met = aln.join(named, same, "full")
    one = F.when(F.col("leaf").isNull() | F.col("taxon").isNull(), F.raise_error(F.lit("rows and leaves that do not match"))).otherwise(F.col("leaf"))
    known = trees.select(F.col("subset").alias("__of")).distinct()
    rows = met.join(known, F.coalesce("subset", "__subset") == F.col("__of"), "left_semi").select("subset", one.alias("leaf"), "seq")
    shapes = trees.groupBy(F.col("subset").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("node", "parent", "len"))).alias("nodes"))
    kind = dict(aln.dtypes)["subset"]

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = []
            for r in frame.itertuples(index=False):
                tree = [(x["node"], x["parent"], x["len"]) for x in r.nodes]
                scores.append(float((pruned([x["pattern"] for x in r.some], tree) * [x["n"] for x in r.some]).sum()))
            yield frame[["subset"]].assign(score=scores)

    # a subset's patterns are dealt to parts, so that a wide alignment is pruned by many tasks
    dealt = patterns(rows).groupBy("subset", F.pmod(F.xxhash64("pattern"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("pattern", "n")).alias("some"))
    met = dealt.join(shapes, F.col("subset").eqNullSafe(F.col("__of"))).select("subset", "some", "nodes")
    sums = met.mapInPandas(scored, f"subset {kind}, score double")
    found = sums.groupBy(F.col("subset").alias("__subset")).agg(F.sum("score").alias("found"))
    return shapes.join(found, F.col("__of").eqNullSafe(F.col("__subset")), "left").select(F.col("__of").alias("subset"), F.coalesce("found", F.lit(0.0)).alias("score"))

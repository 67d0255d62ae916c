"""Alignments, sequences and a tree derived from the given tables, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import batches as B

#: The letters that become residues or gaps, in order of frequency.
LETTERS, RESIDUES = " ETAOINSRHLDCUMFPGWYBVKXJQZ", "-ACGTACGT-ACGTACGT-ACGTACGT"
COLUMNS = 60
#: Taxa are doc_id * BLOCKS + number of the row in its text.
BLOCKS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxon, seq): ragged DNA-like rows."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("taxon"), F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("seq"))


def aligned(spark: SparkSession, sf_dir: str, *also: str | Column) -> DataFrame:
    """(taxon, seq, ...): each whole text as consecutive rows of 60 columns, the last one padded."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("taxon"), F.col("text").alias("seq"), *also)
    return docs.mapInArrow(_in_rows, docs.schema)


#: What each byte of a text becomes; 0 where it is left out.
_BECOMES = np.zeros(256, np.uint8)
for _letter, _residue in zip(LETTERS, RESIDUES, strict=True):
    _BECOMES[[ord(_letter), ord(_letter.lower())]] = ord(_residue)
#: Bytes of text that are worked on at once.
_AT_ONCE = 1 << 22


def _in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # documents of about _AT_ONCE bytes at a time, one at least
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("seq")), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + _AT_ONCE, "right")))
            yield _rows_of(batch.slice(first, last - first))
            first = last


def _rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.cast(batch.column("seq"), pa.large_binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    became = _BECOMES[np.frombuffer(b"".join(t for t in texts.to_pylist() if t), np.uint8)]
    kept = became != 0
    upto = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends]).astype(np.int64)]
    n = np.diff(upto)
    blocks = np.maximum(1, -(-n // COLUMNS))
    begins = np.cumsum(blocks) - blocks
    cells = np.full(int(blocks.sum()) * COLUMNS, ord("-"), np.uint8)
    cells[np.arange(upto[-1]) + np.repeat(begins * COLUMNS - upto[:-1], n)] = became[kept]
    seqs = pa.StringArray.from_buffers(len(cells) // COLUMNS, pa.py_buffer(np.arange(0, len(cells) + 1, COLUMNS, dtype=np.int32)), pa.py_buffer(cells))
    of = pa.array(np.repeat(np.arange(len(n)), blocks))
    block = pa.array(np.arange(len(of)) - np.repeat(begins, blocks))
    # not the texts themselves, which would be copied once a row
    taxa, valid, *others = (c.take(of) for c in (batch.column(0), pc.is_valid(texts), *batch.columns[2:]))
    columns = [pc.add(pc.multiply(taxa, BLOCKS), block), pc.if_else(valid, seqs, pa.scalar(None, pa.string())), *others]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxon): the rows of labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return aligned(spark, sf_dir, "doc_id").join(labels, "doc_id", "left_semi").select("taxon")


def wide(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """(taxon, seq, ...): each whole text as one ragged row, thousands of columns wide."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("taxon"), B.udf("string", _lettered)(F.col("text")).alias("seq"), *also)


def _lettered(texts: pa.Array) -> pa.Array:
    texts = pc.cast(texts, pa.large_binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    became = _BECOMES[np.frombuffer(b"".join(t for t in texts.to_pylist() if t), np.uint8)]
    upto = np.concatenate([[0], np.cumsum(became != 0)])[np.concatenate([[0], ends]).astype(np.int64)]
    return B.texts_of(became[became != 0], upto, pc.is_valid(texts).to_numpy(zero_copy_only=False))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, len, is_leaf): root, regions, nations, customers."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rows = spark.range(1).select(F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("double").alias("len"), F.lit(False).alias("is_leaf"))
    rows = rows.union(region.select((1 + F.col("r_regionkey")).cast("int"), F.lit(0), (F.col("r_regionkey") + 1).cast("double"), F.lit(False)))
    rows = rows.union(nation.select((100 + F.col("n_nationkey")).cast("int"), (1 + F.col("n_regionkey")).cast("int"), (F.col("n_nationkey") + 1).cast("double"), F.lit(False)))
    return rows.union(customer.select((1000 + F.col("c_custkey")).cast("int"), (100 + F.col("c_nationkey")).cast("int"), F.abs("c_acctbal") / 1000, F.lit(True)))


def comb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, len, is_leaf): a tree as deep as there are customers, one of them hanging from each
    node of its spine, in order of key. The spine's nodes are 2 k from the root 0, the customers 2 k + 1."""
    from strandweave.operators.ranks import global_rank

    ranked = global_rank(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    legs = ranked.select((2 * F.col("rank") + 1).alias("node"), (2 * F.col("rank")).alias("parent"), (F.abs("c_acctbal") / 1000).alias("len"), F.lit(True).alias("is_leaf"))
    spine = ranked.select((2 * F.col("rank")).alias("node"), F.when(F.col("rank") > 0, 2 * F.col("rank") - 2).alias("parent"), F.when(F.col("rank") > 0, F.lit(1.0)).alias("len"), F.lit(False).alias("is_leaf"))
    return spine.union(legs)


COMB_SQL = """comb AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer)"""


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxon, seq): a ragged row for each leaf of ``tree``, the priorities of the customer's orders by date; empty without any."""
    letter = F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ACGTN")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("__key")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", letter.alias("ch")))).alias("x"))
    met = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("__key"), "left")
    return met.select((1000 + F.col("c_custkey")).cast("int").alias("taxon"), F.coalesce(F.array_join(F.col("x.ch"), ""), F.lit("")).alias("seq"))


HISTORIES_SQL = """histories AS (SELECT CAST(1000 + c_custkey AS INT) AS taxon, coalesce((SELECT string_agg(translate(left(o_orderpriority, 1), '12345', 'ACGTN'), '' ORDER BY o_orderdate, o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS seq FROM customer)"""
WIDE_SQL = f"wide AS (SELECT doc_id AS taxon, translate(upper(regexp_replace(text, '[^ A-Za-z]', '', 'g')), '{LETTERS}', '{RESIDUES}') AS seq, source FROM documents)"
UNALIGNED_SQL = "unaligned AS (SELECT doc_id AS taxon, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents)"
ALIGNED_SQL = f"""lettered AS (SELECT doc_id, lang, source, upper(regexp_replace(text, '[^ A-Za-z]', '', 'g')) AS letters FROM documents),
blocks AS (SELECT *, unnest(range(greatest(1, (coalesce(length(letters), 0) + {COLUMNS - 1}) // {COLUMNS}))) AS block FROM lettered),
aligned AS (SELECT doc_id * {BLOCKS} + block AS taxon, rpad(translate(substr(letters, block * {COLUMNS} + 1, {COLUMNS}), '{LETTERS}', '{RESIDUES}'), {COLUMNS}, '-') AS seq, lang, source FROM blocks)"""
CELLS_SQL = f"spread AS (SELECT taxon, source, CAST(i AS INT) AS col, substr(seq, CAST(i AS INT) + 1, 1) AS ch FROM aligned, range({COLUMNS}) r(i)), cells AS (SELECT * FROM spread WHERE ch <> '-')"
COUNTS_SQL = f"counts AS (SELECT CAST(r.i AS INT) AS col, count(c.ch) AS n FROM range({COLUMNS}) r(i) LEFT JOIN cells c ON c.col = r.i GROUP BY r.i)"
TREE_SQL = """tree AS (
  SELECT 0 AS node, CAST(NULL AS INT) AS parent, CAST(NULL AS DOUBLE) AS len, false AS is_leaf
  UNION ALL SELECT CAST(1 + r_regionkey AS INT), 0, CAST(r_regionkey + 1 AS DOUBLE), false FROM region
  UNION ALL SELECT CAST(100 + n_nationkey AS INT), CAST(1 + n_regionkey AS INT), CAST(n_nationkey + 1 AS DOUBLE), false FROM nation
  UNION ALL SELECT CAST(1000 + c_custkey AS INT), CAST(100 + c_nationkey AS INT), abs(c_acctbal) / 1000, true FROM customer),
anc AS (
  SELECT node, node AS anc, CAST(0 AS DOUBLE) AS dist, 0 AS hops FROM tree
  UNION ALL SELECT a.node, t.parent, a.dist + coalesce(t.len, 0), a.hops + 1 FROM anc a JOIN tree t ON t.node = a.anc WHERE t.parent IS NOT NULL),
leaf_counts AS (SELECT a.anc AS node, count(*) AS n_leaves FROM anc a JOIN tree t ON t.node = a.node WHERE t.is_leaf GROUP BY a.anc)"""

"""The corpus pipeline: filters, near-duplicate removal, mixing and packing, one stage after another.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again for the next. All but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import jaccard, mixing, packing, quality, toxicity
from strandweave.llm.common import read, removed, settled, shared_folder, small, with_score

_SCORE, _ID = "__stage_score", "__stage_id"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is below 0.5.

    Null and empty texts hold nothing toxic and stay; repeated rows share their fate; without labels
    of both classes every document stays. An empty table stays empty; other columns pass through.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return with_score(docs, "text", model, _SCORE).where(F.col(_SCORE) < 0.5).drop(_SCORE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is at least 0.7.

    Null and empty texts have the score of a text without words; repeated rows share their fate;
    without labels every document stays. An empty table stays empty; other columns pass through.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return with_score(docs, "text", model, _SCORE).where(F.col(_SCORE) >= quality.THRESHOLD).drop(_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Documents without an id, and texts without words, belong to no group and stay; rows that repeat
    an id count as one document and stay or go together.
    """
    found = jaccard.near_duplicates(docs)
    side = small(*settled(found.where("component_id <> doc_id").select(F.col("doc_id").alias(_ID)).distinct()))
    return docs.join(side, docs["doc_id"] == side[_ID], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 3 times.

    Texts without words have size 0: they are taken whenever their source's threshold takes them.
    Null sources are a source like others.
    """
    return mixing.mix(docs, keep=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; the mix's repeats are documents of their own, null and
    empty texts their end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Two stages score texts with trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder; what it was made of goes then."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs

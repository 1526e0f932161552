"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept and returns documents
with the same columns; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm.batches import unused
from tallyshelf.llm.chunks import dedup_lines
from tallyshelf.llm.minmax import near_duplicates
from tallyshelf.llm.mixing import mix
from tallyshelf.llm.packing import pack
from tallyshelf.llm.quality import classify
from tallyshelf.scratch import broadcast_if_small, drop, recorded, stage


def columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, those without text by their
    site's rate.  Repeated rows are judged each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (name,) = unused(docs.columns, "quality")
    return classify(docs, labels, into=name).filter(F.col(name)["kept"]).select(*columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their globally repeated passages; those of which nothing is left
    (copies of earlier ones) go.  Null and empty texts and rows without doc_id stay
    as they are; repeated rows stay alike."""
    return dedup_lines(docs, keep_emptied=False)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; those without words or doc_id
    stay, and so do all rows of a doc_id that stays."""
    gone = stage(near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "pipeline-gone")
    (name,) = unused(docs.columns, "gone")
    gone = broadcast_if_small(gone).toDF(name)
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti").select(*columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned to the sources' target weights; those without
    words have size 0 and follow their source's rate, a null source is a source."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens; null
    and empty texts are one token, every row is packed for itself."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicate), ("mixing", mixing), ("packing", packing)]

#: No SQL: the stages train a model, hash, and encode tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with recorded() as written:
        for name, function in STAGES[:-1]:
            docs = stage(function(spark, docs, sf_dir).select(*columns(docs)), f"pipeline-{name}")
            drop(spark, written, keep=1)  # what the stage read is not read again
    return STAGES[-1][1](spark, docs, sf_dir)

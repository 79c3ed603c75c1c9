"""The corpus pipeline: quality, near duplicates, shared passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the one
before it kept; its decisions take effect. All but the last return the columns
of documents. Empty tables pass through all stages; nulls, repeated rows and
rows that share a doc_id are dealt with as each operator says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.llm.best_fit_packing import TOKENIZER, pack, tokenized_pieces
from stratalith.llm.minhash_dedup import near_duplicates, text_key
from stratalith.llm.quality_classifier import kept_documents
from stratalith.llm.session import ensure_checkpoint_dir
from stratalith.llm.source_mixing import mixed_documents
from stratalith.llm.substring_dedup import repeats_removed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id; rows without id stay.

    Of rows that share a doc_id those go whose text is in another's class; of rows
    that repeat id and text one stays.
    """
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "said").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("said"))
    one = F.row_number().over(Window.partitionBy("id", "said").orderBy(F.xxhash64("row")))
    alone = rows.filter("id IS NOT NULL").join(kept.hint("merge"), ["id", "said"], "left_semi").withColumn("n", one).filter("n = 1")
    return alone.select("row.*").unionByName(rows.filter("id IS NULL").select("row.*"))


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages kept in another document go; a document of which nothing is left goes with them."""
    return repeats_removed(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of at most 1024 tokens."""
    return pack(tokenized_pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicate),
    ("substring dedup", shared_passages),
    ("source mixing", mixing),
    ("best-fit packing", packing),
]

#: Fitted models, hashing and tokenisers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again, and goes when the next one is there."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs

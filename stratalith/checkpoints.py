"""Where to checkpoint, and cutting a lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 100_000  # rows of keys that are broadcast; more are joined by key


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where it is unset (tests), a local temporary one."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(named)
    return named


def dealt(rows: DataFrame, key: str, each: int = 10_000) -> DataFrame:
    """rows of a table in partitions of about ``each`` by key, where there are fewer: small files that cost much work a row."""
    wanted = -(-rows.count() // each)
    return rows.repartition(wanted, key) if rows.rdd.getNumPartitions() < wanted else rows


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder, with the lineage cut; a lost executor loses none of them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(rows: DataFrame) -> DataFrame:
    """Checkpointed rows of keys as a broadcast, if they are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows

"""Documents of numbered blocks as text files: the files of a folder, in the order of their names, are the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blocks(blocks: DataFrame, folder: str) -> None:
    """Writes (n, text): each file holds a range of blocks, a newline after each; a null text is an empty line."""
    ordered = blocks.select("n", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("n").sortWithinPartitions("n")
    ordered.select(F.col("text").alias("value")).write.text(folder)


def write_files(blocks: DataFrame, by: str, folder: str) -> None:
    """Writes (by, n, text), many documents one behind the other: each has a folder, whose files in the order of their names are the document."""
    ordered = blocks.select(by, "n", F.coalesce("text", F.lit("")).alias("value")).repartitionByRange("n").sortWithinPartitions(by, "n")
    ordered.select(by, "value").write.partitionBy(by).text(folder)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line, text): the lines of each file from 0, the last empty one left out; files are read whole, so that their size bounds a row."""
    whole = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1).alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line", "text"))

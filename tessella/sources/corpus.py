"""Reads of corpus folders, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Rows (path, text) of the files below a folder that are UTF-8; others are skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return raw.where(F.is_valid_utf8("content")).select("path", F.decode("content", "UTF-8").alias("text"))


def registers(files: DataFrame, first: int | None = None) -> DataFrame:
    """Adds ``register``, the folder that a file is in; with ``first``, that many files of each by path."""
    named = files.withColumn("register", F.element_at(F.split("path", "/"), -2))
    if first is None:
        return named
    rank = F.row_number().over(Window.partitionBy("register").orderBy("path"))
    return named.withColumn("n", rank).where(F.col("n") <= first).drop("n")


def save_report(rows: DataFrame, path: str) -> None:
    """Writes a report's rows as JSON lines."""
    rows.write.mode("overwrite").json(path)

"""Readers of the driver's tables and of files; sinks for ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows are long texts, worth spreading when they come in too few files.
TEXTS = {"documents", "pages", "conversations"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's.

    A file's row group is one task's; where texts come in fewer files than there are
    cores, as small tables do, rows are dealt out. Large tables are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, text), one for each whole file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

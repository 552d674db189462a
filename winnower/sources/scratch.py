"""Paths in the folder that driver and executors share; sizes of the batches sent to Python."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

#: Rows and bytes in one Arrow batch sent to a Python worker: whichever ends first, so
#: that a worker holds this much or one longer text.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is taken on a single machine (``local``);
    on a cluster no such folder is shared, and it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="winnower-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def observed(df: DataFrame, label: str, seen: Observation) -> tuple[DataFrame, dict]:
    """As ``cut``, with the metrics of ``seen``, which some step of ``df`` observes."""
    out = cut(df, label)
    return out, seen.get


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Compositions of large expressions are cut here: the optimizer would otherwise
    see one expression of their product, and a lost executor their recomputation.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for tables of long texts.

    The session's limits are lowered, never raised; Spark reads them when a plan
    runs, so they stay lowered.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")

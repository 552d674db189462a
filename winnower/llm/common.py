"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.sources.scratch import BATCH_BYTES, BATCH_ROWS, small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark parses it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, but: Iterable[str] = ()) -> list[Column]:
    """The columns of ``df`` without those named as in ``but`` (in any case)."""
    gone = {c.lower() for c in but}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def plainly(df: DataFrame, but: Iterable[str], *more: Column) -> tuple[DataFrame, list[Column]]:
    """The columns of ``df`` without ``but``, and ``more``, under names that Python functions take.

    The second value gives the first columns their own names back.
    """
    gone = {c.lower() for c in but}
    kept = [c for c in df.columns if c.lower() not in gone]
    plain = df.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(kept)), *(c.alias(f"more{k}") for k, c in enumerate(more)))
    return plain, [F.col(f"c{k}").alias(c) for k, c in enumerate(kept)]


def free(df: DataFrame, *labels: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in labels:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that Spark can hash (maps and variants can't be)."""
    def plain(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(plain(f.dataType) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return plain(t.elementType)
        return not isinstance(t, (T.MapType, T.VariantType))

    return F.xxhash64(F.lit(0), *(F.col(quoted(f.name)) for f in df.schema.fields if plain(f.dataType)))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``; where that is unset, a
    temporary folder is taken on a single machine (``local``), and on a cluster,
    where no such folder is shared, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="winnower-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of files, never the
    recomputation of an iterative plan, and a table with several readers is
    computed once.
    """
    return counted(df, label)[0]


def counted(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, Row]:
    """As ``materialise``, with the number of rows ``n`` (and more ``metrics``) seen while writing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *metrics).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), Row(**seen.get)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, component)``.

    ``component`` is the smallest id reachable. An id without a row is its own
    component: one without edges, or the smallest of its component. Null ends and
    self-loops are ignored, repeated edges do no harm, an empty input gives an empty
    result.

    Large-star and small-star turns alternate until the edges are a star around the
    smallest id of each component. A turn is a partially aggregated minimum and an
    equi-join with it, so a node of very many edges is neither collected nor paired
    with itself; the number of turns is logarithmic. Nothing goes to the driver but
    a count and a checksum, and each turn is written to the shared folder.
    """
    sums = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum")
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    live, now = counted(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges", sums)
    while now.n:
        # large star: of each node, every larger neighbour is tied to the smallest of all
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.col("c")).alias("m"))
        tied = both.select(F.col("a").alias("c"), F.col("b").alias("v")).where("v > c").join(low, "c").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialise(tied.distinct(), f"{label}-large")
        # small star: of each node, the node and its smaller neighbours are tied to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, then = counted(rest.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), f"{label}-edges", sums)
        discard(live)
        discard(large)
        live, before, now = new, now, then
        if (before.n, before.sum) == (now.n, now.sum):
            break
    return live.select(F.col("a").alias("id"), F.col("b").alias("component"))

"""Ledgers, notes and session stores as files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.operators.ledger import SCHEMA
from winnower.sources import tables
from winnower.sources.scratch import scratch


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """Rows of a JSON-lines file; blank and torn lines are left out, missing keys are null."""
    torn = T.StructType([*schema.fields, T.StructField("_torn", T.StringType())])
    rows = spark.read.schema(torn).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    # filtered by a column of the record, as a query of the torn column alone is refused
    return rows.where(F.col("_torn").isNull() & F.greatest(*(F.col(c).isNotNull() for c in schema.names), F.lit(False))).select(schema.names)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows; the committer makes each append all or nothing."""
    df.write.mode("append").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """The rows of a legacy file that is one JSON array, to be appended to a ledger."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def migrate_json_array(spark: SparkSession, legacy: str, path: str, schema: T.StructType = SCHEMA) -> bool:
    """Turn a legacy file of one JSON array into a JSON-lines ledger, once; whether that was done.

    Nothing happens if the ledger is there already or the legacy file isn't. The
    legacy file is renamed, so that it is not read again.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(legacy), jvm.org.apache.hadoop.fs.Path(path)
    files = old.getFileSystem(conf)
    if new.getFileSystem(conf).exists(new) or not files.exists(old):
        return False
    append_jsonl(read_json_array(spark, legacy, schema), path)
    return files.rename(old, jvm.org.apache.hadoop.fs.Path(f"{legacy}.migrated"))


def export_all_keys(spark: SparkSession, records: str, path: str) -> DataFrame:
    """Export JSON lines to CSV under all keys that any record has, in order of first appearance.

    What comes back is the table that was written. Keys are few: their names go to
    the driver.
    """
    lines = spark.read.text(records).where(F.trim("value") != "")
    place = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    keys = lines.select(place.alias("at"), F.posexplode(F.json_object_keys("value")).alias("pos", "key"))
    names = [r.key for r in keys.groupBy("key").agg(F.min(F.struct("at", "pos")).alias("first")).orderBy("first").collect()]
    out = lines.select(*(F.get_json_object("value", f"$['{k}']").alias(k) for k in names))
    export_csv(out, path)
    return out


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a parquet table by rows derived from it: written beside it first."""
    spark = df.sparkSession
    beside = scratch(spark, "overwrite")
    df.write.parquet(beside)
    spark.read.schema(df.schema).parquet(beside).write.mode("overwrite").parquet(path)


def new_notes(notes: DataFrame, known: DataFrame | None, text: str = "text") -> DataFrame:
    """Notes (content_hash, text, ...) not yet known; the first of equal texts, by its columns."""
    hashed = notes.withColumn("content_hash", F.sha2(F.trim(text), 256))
    rest = [F.col(c) for c in hashed.columns if c != "content_hash"]
    one = hashed.groupBy("content_hash").agg(F.min(F.struct(*rest)).alias("f")).select("content_hash", "f.*")
    return one if known is None else one.join(known.select("content_hash"), "content_hash", "left_anti")


def jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a session database; the driver's jar must be on the class path."""
    return spark.read.jdbc(url, table, properties=properties or {})


def jdbc_append(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    df.write.jdbc(url, table, mode="append", properties=properties or {})


def calls_by_session(calls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Sessions (session_id, first_seen, last_seen, call_count, tokens_saved) of calls, added to those known."""
    new = calls.groupBy("session_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("call_count"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).cast("long").alias("tokens_saved"))
    if known is None:
        return new
    both = known.select(new.columns).unionAll(new)
    return both.groupBy("session_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("call_count").alias("call_count"), F.sum("tokens_saved").alias("tokens_saved"))


def expired(sessions: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Sessions that have been quiet for longer than the time to live."""
    return sessions.where(F.col("last_seen") < now - F.make_interval(secs=F.lit(ttl_seconds)))


class MemoryTable:
    """A table with a time to live for entries and a bound on their number, kept as Parquet.

    ``put`` replaces entries of the same key (the last one written counts); where more
    than ``most`` are alive, the oldest go. ``get`` joins, so that many keys are asked
    for at once.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int, most: int) -> None:
        self.spark, self.path, self.ttl, self.most = spark, path, ttl_seconds, most
        self.schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("created_at", T.TimestampType())])

    def entries(self) -> DataFrame:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(conf).exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def put(self, rows: DataFrame, now) -> None:
        new = rows.select("key", "value", F.lit(now).cast("timestamp").alias("created_at"))
        last = self.entries().unionAll(new).groupBy("key").agg(F.max(F.struct("created_at", "value")).alias("e")).select("key", "e.value", "e.created_at")
        overwrite(newest(live(last, F.lit(now).cast("timestamp"), self.ttl), self.most, tie="key"), self.path)

    def get(self, keys: DataFrame, now) -> DataFrame:
        """Rows (key, value) of the keys asked for that are alive."""
        return live(self.entries(), F.lit(now).cast("timestamp"), self.ttl).join(keys.select("key").distinct(), "key", "left_semi").select("key", "value")


def live(table: DataFrame, now, ttl_seconds: int, created: str = "created_at") -> DataFrame:
    """Entries younger than the time to live."""
    return table.where(F.col(created) >= now - F.make_interval(secs=F.lit(ttl_seconds)))


def newest(table: DataFrame, most: int, created: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest entries of a store of bounded size."""
    return table.orderBy(F.desc(created), F.desc(tie)).limit(most)


def ledger_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, with torn and blank lines, and read back."""
    path = scratch(spark, "ledger")
    e = tables.read(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("tool"), F.col("event_id").alias("tokens_before"), F.col("user_id").cast("string").alias("session_id")))
    torn = F.when(F.pmod("event_id", F.lit(10)) == 0, F.substring(line, 1, 12)).when(F.pmod("event_id", F.lit(10)) == 1, "").otherwise(line)
    e.select(torn.alias("value")).write.text(path)
    return read_jsonl(spark, path).select("tool", "tokens_before", "session_id")


def ledger_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    export_csv(tables.read(spark, sf_dir, "events").select("event_id", "event_type", "props"), path)
    return spark.read.option("header", "true").schema("event_id long, event_type string, props string").option("escape", "\\").csv(path)


def shared_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts as notes of agents; those of the first conversation are known."""
    c = tables.read(spark, sf_dir, "conversations").select(F.col("text"), F.col("role").alias("agent"), "conv_id")
    known = new_notes(c.where("conv_id = 0").select("text", "agent"), None)
    return new_notes(c.where("conv_id > 0").select("text", "agent"), known)


QUERIES = {"ledger_jsonl": ledger_roundtrip, "ledger_csv": ledger_csv, "shared_notes": shared_notes}
ORACLES = {
    "ledger_jsonl": "SELECT event_type AS tool, event_id AS tokens_before, user_id::VARCHAR AS session_id FROM events WHERE event_id % 10 > 1",
    "ledger_csv": "SELECT event_id, event_type, props FROM events",
    "shared_notes": "WITH n AS (SELECT sha256(trim(text, ' ')) AS content_hash, min({'t': text, 'a': role}) AS f FROM conversations WHERE conv_id > 0 GROUP BY 1) SELECT content_hash, f.t AS text, f.a AS agent FROM n WHERE content_hash NOT IN (SELECT sha256(trim(text, ' ')) FROM conversations WHERE conv_id = 0)",
}

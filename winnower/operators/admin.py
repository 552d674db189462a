"""Administration of rules and stores, counters, and the memory that agents recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnower.operators import ledger, retrieval
from winnower.sources import tables
from winnower.sources.stores import new_notes

EVENTS_KEPT, RETENTION_DAYS = 8000, 30


def add_rules(rules: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``rules`` (ip, kind, reason, expires_at, auto, hits) with ``new`` ones (ip, kind, reason, minutes, auto).

    A new rule replaces that of the same address and kind; null minutes never expire.
    """
    made = new.select("ip", "kind", "reason", F.when(F.col("minutes").isNotNull(), now + F.make_interval(mins=F.col("minutes").cast("int"))).alias("expires_at"), F.coalesce("auto", F.lit(False)).alias("auto"), F.lit(0).cast("long").alias("hits"))
    return rules.join(made.select("ip", "kind"), ["ip", "kind"], "left_anti").unionByName(made)


def active_rules(rules: DataFrame, now: Column, kind: str | None = None) -> DataFrame:
    live = rules.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return live if kind is None else live.where(F.col("kind") == kind)


def delete_rules(rules: DataFrame, ips: DataFrame, kind: str) -> DataFrame:
    gone = ips.select("ip").withColumn("kind", F.lit(kind))
    return rules.join(gone, ["ip", "kind"], "left_anti")


def trim_events(events: DataFrame, now: Column, days: int = RETENTION_DAYS, most: int = EVENTS_KEPT, tie: str = "event_id") -> DataFrame:
    """The newest events inside the retention; how many is the store's bound."""
    return events.where(F.col("ts") >= now - F.make_interval(days=F.lit(days))).orderBy(F.desc("ts"), F.desc(tie)).limit(most)


def counters(led: DataFrame, decisions: DataFrame, known_backends: dict[str, bool]) -> DataFrame:
    """Rows (counter, n): sessions, calls, decisions and warnings of missing backends."""
    spark = led.sparkSession
    parts = led.agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("ledger_rows"))
    a = parts.select(F.explode(F.create_map(F.lit("sessions"), "sessions", F.lit("ledger_rows"), "ledger_rows")).alias("counter", "n"))
    b = decisions.agg(F.count(F.lit(1)).alias("n")).select(F.lit("decisions").alias("counter"), "n")
    w = spark.createDataFrame([(f"missing_{k}", 0 if there else 1) for k, there in sorted(known_backends.items())], "counter string, n long")
    return a.unionByName(b).unionByName(w)


def with_memory(messages: DataFrame, notes: DataFrame, k: int = 3) -> DataFrame:
    """Messages (id, text) with the notes (note_id, text) they recall in front, each as ``[memory] …``."""
    near = retrieval.recall(notes, "note_id", messages, "id", k)
    told = near.join(notes.select(F.col("note_id"), F.col("text").alias("note")), F.col("id") == F.col("note_id")).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "note"))).alias("m"))
    out = messages.join(told, messages["id"] == told["query"], "left")
    lines = F.transform(F.coalesce("m", F.array().cast("array<struct<rank:int,note:string>>")), lambda x: F.concat(F.lit("[memory] "), x["note"]))
    return out.select("id", F.array_join(F.concat(lines, F.array("text")), "\n").alias("text"))


def remember(notes: DataFrame, messages: DataFrame) -> DataFrame:
    """Notes (content_hash, text, agent) with the messages that are new."""
    return notes.unionByName(new_notes(messages.select("text", "agent"), notes))


def ip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made from events: errors block, purchases allow; the newest of an address and kind counts."""
    e = tables.read(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "error", "Block").otherwise("Allow")
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    new = e.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("user_id").cast("string").alias("ip"), kind.alias("kind"), F.lit("from events").alias("reason"), F.when(F.pmod("event_id", F.lit(2)) == 0, 60).alias("minutes"), F.lit(True).alias("auto"))
    now = F.lit("2024-01-01").cast("timestamp")
    old = spark.createDataFrame([("1", "Block", "old", None, False, 7), ("x", "Block", "old", None, False, 7)], "ip string, kind string, reason string, expires_at timestamp, auto boolean, hits long")
    out = active_rules(add_rules(old, new, now), now)
    return out.select("ip", "kind", "reason", F.date_format("expires_at", "yyyy-MM-dd HH:mm").alias("expires_at"), "auto", "hits")


def event_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return trim_events(e, F.lit(e.agg(F.max("ts")).first()[0]), 5, 500).select("event_id")


def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents")
    return counters(ledger.from_events(spark, sf_dir), d, {"vector_store": True, "redis": False})


def memory_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return with_memory(m, tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("note_id"), "text"), 1)


QUERIES = {"ip_rules": ip_rules, "event_trim": event_trim, "store_counters": store_counters, "memory_messages": memory_messages}
ORACLES = {
    "ip_rules": """WITH n AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS e FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL)
      SELECT user_id::VARCHAR AS ip, CASE event_type WHEN 'error' THEN 'Block' ELSE 'Allow' END AS kind, 'from events' AS reason, CASE WHEN e % 2 = 0 THEN '2024-01-01 01:00' END AS expires_at, true AS auto, 0::BIGINT AS hits FROM n
      UNION ALL SELECT ip, 'Block', 'old', NULL, false, 7 FROM (VALUES ('1'), ('x')) t(ip) WHERE ip NOT IN (SELECT user_id::VARCHAR FROM n WHERE event_type = 'error')""",
    "event_trim": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY ORDER BY ts DESC, event_id DESC LIMIT 500",
    "store_counters": "SELECT 'sessions' AS counter, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'ledger_rows', count(*) FROM events UNION ALL SELECT 'decisions', count(*) FROM documents UNION ALL SELECT 'missing_redis', 1 UNION ALL SELECT 'missing_vector_store', 0",
    "memory_messages": "WITH r AS (" + retrieval.ORACLES["cosine_recall"].replace("SELECT doc_id AS id, term, count(*) AS n FROM (SELECT doc_id, unnest", "SELECT item_id AS id, term, count(*) AS n FROM (SELECT item_id, unnest", 1).replace("FROM documents) WHERE", "FROM benchmark) WHERE", 1)
    .replace("SELECT item_id AS query, term, count(*) AS m FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS term FROM benchmark)", "SELECT mid AS query, term, count(*) AS m FROM (SELECT conv_id * 1000 + turn AS mid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS term FROM conversations WHERE role = 'user')")
    + ") SELECT c.conv_id * 1000 + c.turn AS id, CASE WHEN b.text IS NOT NULL THEN '[memory] ' || b.text || chr(10) ELSE '' END || c.text AS text FROM conversations c LEFT JOIN (SELECT * FROM r WHERE rank = 1) r ON r.query = c.conv_id * 1000 + c.turn LEFT JOIN benchmark b ON b.item_id = r.id WHERE c.role = 'user'",
}

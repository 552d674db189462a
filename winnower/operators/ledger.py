"""Ledger analytics: records of calls, summaries, sessions, findings.

A ledger is a table (ts, tool, tokens_before, tokens_after, tokens_saved,
cost_usd_saved, content_type, language, session_id, duration_ms, pii_masked_count).
In the queries it is derived from ``events``: a user is a session, an event type a
tool, the value gives tokens and duration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.functions.tokens import CO2_MG, ENERGY_MWH
from winnower.operators import guards
from winnower.sources import tables

PRICE = 3e-6
ACTIVE_SECONDS = 300
LEAST_CALLS, LOW_EFFICIENCY, LEAST_FAILURES = 5, 15.0, 3

SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("tool", T.StringType()), T.StructField("tokens_before", T.LongType()), T.StructField("tokens_after", T.LongType()),
    T.StructField("tokens_saved", T.LongType()), T.StructField("cost_usd_saved", T.DoubleType()), T.StructField("content_type", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("session_id", T.StringType()), T.StructField("pid", T.IntegerType()), T.StructField("duration_ms", T.DoubleType()), T.StructField("pii_masked_count", T.IntegerType()),
])


def record(calls: DataFrame) -> DataFrame:
    """``calls`` with tokens_saved and cost_usd_saved."""
    saved = F.greatest(F.lit(0).cast("long"), F.col("tokens_before") - F.col("tokens_after"))
    return calls.withColumn("tokens_saved", saved).withColumn("cost_usd_saved", F.bround(F.col("tokens_saved") * F.lit(PRICE), 8))


def since(ledger: DataFrame, now: Column, days: int) -> DataFrame:
    """Records of the last days; those without a valid time are left out."""
    return ledger.where(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def prune(ledger: DataFrame, now: Column, days: int) -> DataFrame:
    """What stays after older records are deleted; those without a valid time stay."""
    return ledger.where(F.col("ts").isNull() | (F.col("ts") >= now - F.make_interval(days=F.lit(days))))


def without_session(ledger: DataFrame, session: str) -> DataFrame:
    """What stays after a session's records are deleted; records without a session stay."""
    return ledger.where(~F.col("session_id").eqNullSafe(F.lit(session)))


def emptied(ledger: DataFrame) -> DataFrame:
    """The ledger after a reset: its columns and no record."""
    return ledger.limit(0)


def recent(ledger: DataFrame, limit: int, tie: str) -> DataFrame:
    return ledger.orderBy(F.desc("ts"), F.desc(tie)).limit(limit)


def totals(ledger: DataFrame) -> DataFrame:
    """One row of totals; zeros for an empty ledger."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = ledger.agg(
        F.count(F.lit(1)).alias("total_calls"), total("tokens_saved").alias("tokens_saved"), total("tokens_before").alias("tokens_before"), total("tokens_after").alias("tokens_after"),
        F.coalesce(F.bround(F.sum(F.coalesce("cost_usd_saved", F.col("tokens_saved") * PRICE)), 6), F.lit(0.0)).alias("cost_usd_saved"), total("pii_masked_count").alias("pii_masked_count"),
    )
    efficiency = F.when(F.col("tokens_before") > 0, F.bround(F.col("tokens_saved") / F.col("tokens_before") * 100, 2)).otherwise(0.0)
    energy = F.col("tokens_saved") * ENERGY_MWH
    return sums.withColumn("avg_efficiency_pct", efficiency).withColumn("energy_mwh_saved", F.bround(energy, 3)).withColumn("co2_mg_saved", F.bround(energy * CO2_MG, 3))


def latency(ledger: DataFrame) -> DataFrame:
    """One row (avg, p95, max) of durations; null and zero ones don't count.

    p95 is the element at floor(0.95 n) of the sorted durations. Equal durations are
    counted first, so what is sorted is the distinct values.
    """
    counts = ledger.where("duration_ms is not null and duration_ms <> 0").groupBy("duration_ms").agg(F.count(F.lit(1)).alias("n"))
    # ranges of values are summed before the running sum, so that no task sorts them all
    slot = F.floor(F.log2(F.greatest(F.abs("duration_ms"), F.lit(1e-9))) * 64)
    counts = counts.withColumn("slot", F.when(F.col("duration_ms") < 0, -1e6 - slot).otherwise(slot))
    slots = counts.groupBy("slot").agg(F.sum("n").alias("in_slot"))
    before = F.coalesce(F.sum("in_slot").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.withColumn("before", before)
    # one row to the driver; everything below is found from it
    s = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("n") * F.col("duration_ms")).alias("total"), F.max("duration_ms").alias("top")).first()
    at = int(s.n * 0.95)
    near = counts.join(slots, "slot").where((F.col("before") <= at) & (F.lit(at) < F.col("before") + F.col("in_slot")))
    upto = near.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("slot").orderBy("duration_ms")))
    p95 = upto.where(F.col("upto") > at).agg(F.min("duration_ms").alias("p95"))
    known = [F.bround(F.lit(s.total / s.n), 1), F.bround(F.lit(s.top), 1)] if s.n else [F.lit(0.0), F.lit(0.0)]
    return p95.select(known[0].alias("avg_latency_ms"), F.coalesce(F.bround("p95", 1), F.lit(0.0)).alias("p95_latency_ms"), known[1].alias("max_latency_ms"))


def by(ledger: DataFrame, column: str, blank: str = "unknown") -> DataFrame:
    """Tokens saved by tool or content type; an empty name is ``blank``."""
    name = F.when(F.coalesce(F.trim(column), F.lit("")) == "", blank).otherwise(F.col(column))
    return ledger.groupBy(name.alias(column)).agg(F.sum("tokens_saved").alias("tokens_saved"))


def sessions(ledger: DataFrame) -> DataFrame:
    """One row for each session, with its sorted tools and first and last time."""
    sid = F.when(F.coalesce("session_id", F.lit("")) == "", "unknown").otherwise(F.col("session_id"))
    return ledger.groupBy(sid.alias("session_id")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_saved").alias("tokens_saved"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("tool", F.lit("")))), ",").alias("tools"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def active_sessions(ledger: DataFrame, now: Column, seconds: int = ACTIVE_SECONDS, lifetime: bool = True) -> DataFrame:
    """Sessions with a call in the last seconds; their calls of all time, or of that time only."""
    inside = F.col("ts") >= now - F.make_interval(secs=F.lit(seconds))
    counted = ledger if lifetime else ledger.where(inside)
    return counted.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_saved").alias("tokens_saved"), F.max("ts").alias("last_ts"), F.max(inside.cast("int")).alias("live")).where("live = 1").drop("live")


def findings(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows (kind, subject, n, value): tools that save little, blocks, failures."""
    weak = ledger.where("tokens_before > 0").groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before") * 100).alias("value"))
    weak = weak.where((F.col("n") >= LEAST_CALLS) & (F.col("value") < LOW_EFFICIENCY)).select(F.lit("low_efficiency").alias("kind"), F.col("tool").alias("subject"), "n", F.round("value", 6).alias("value"))
    blocks = requests.where("blocked").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_FAILURES).select(F.lit("blocked").alias("kind"), F.lit("").alias("subject"), "n", F.lit(0.0).alias("value"))
    failed = requests.where("not responded").groupBy("upstream").agg(F.count(F.lit(1)).alias("n"))
    worst = failed.agg(F.sum("n").alias("all"), F.max(F.struct("n", "upstream")).alias("w")).where(F.col("all") >= LEAST_FAILURES)
    return weak.unionByName(blocks).unionByName(worst.select(F.lit("failures").alias("kind"), F.col("w.upstream").alias("subject"), F.col("w.n").alias("n"), F.lit(0.0).alias("value")))


def redacted(decisions: DataFrame, text: str = "text") -> DataFrame:
    """``decisions`` as they may be stored: secrets replaced by a marker, with their class."""
    d = decisions.withColumn("secret", guards.secret_class(text))
    return d.withColumn(text, F.when(F.col("secret").isNotNull(), F.concat(F.lit("[redacted: "), F.col("secret"), F.lit("]"))).otherwise(F.col(text)))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    before = (F.floor(F.abs("value")) + F.pmod("event_id", F.lit(40))).cast("long")
    after = F.when(F.col("event_type") == "view", before).otherwise(F.floor(before * 0.6).cast("long"))
    calls = e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), before.alias("tokens_before"), after.alias("tokens_after"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "").otherwise("text").alias("content_type"), F.col("user_id").cast("string").alias("session_id"),
        F.when(F.pmod("event_id", F.lit(7)) == 0, 0.0).otherwise(F.round(F.abs("value"), 3)).alias("duration_ms"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("pii_masked_count"),
    )
    return record(calls)


def _now(spark, sf_dir):
    return F.lit(tables.read(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0])


def ledger_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir).select("event_id", "tokens_before", "tokens_after", "tokens_saved", F.round("cost_usd_saved", 8).alias("cost_usd_saved"))


def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(from_events(spark, sf_dir))


def ledger_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency(from_events(spark, sf_dir))


def ledger_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by(from_events(spark, sf_dir), "tool", "")


def ledger_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by(from_events(spark, sf_dir), "content_type")


def ledger_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(from_events(spark, sf_dir))
    return s.withColumn("first_ts", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss")).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


def ledger_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return since(from_events(spark, sf_dir), _now(spark, sf_dir), 7).select("event_id", "tokens_saved")


def ledger_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune(from_events(spark, sf_dir), _now(spark, sf_dir), 3).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def ledger_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest records; the limit is the operator."""
    return recent(from_events(spark, sf_dir), 20, "event_id").select("event_id", "tool", "tokens_saved")


def sessions_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, now = from_events(spark, sf_dir), _now(spark, sf_dir)
    a = active_sessions(led, now, 36_000).select("session_id", F.col("calls").alias("lifetime_calls"))
    b = active_sessions(led, now, 36_000, lifetime=False).select("session_id", F.col("calls").alias("recent_calls"))
    return a.join(b, "session_id")


def learn_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    requests = e.select((F.col("event_type") == "error").alias("blocked"), (F.col("event_type") != "error").alias("responded"), F.concat(F.lit("up"), F.pmod("user_id", F.lit(5))).alias("upstream"))
    return findings(from_events(spark, sf_dir), requests)


def decisions(records: DataFrame, limit: int = 50, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The most recent decisions."""
    return records.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select(F.sha2(F.concat(F.lit("decision:"), "doc_id"), 256).alias("id"), "doc_id", "text")
    return redacted(d).select("id", "doc_id", "secret", F.sha2("text", 256).alias("stored"))


_LED = """led AS (SELECT *, greatest(0, tokens_before - tokens_after) AS tokens_saved, round(greatest(0, tokens_before - tokens_after) * 3e-6::DOUBLE, 8) AS cost_usd_saved FROM (
  SELECT event_id, ts, event_type AS tool, b AS tokens_before, CASE WHEN event_type = 'view' THEN b ELSE floor(b * 0.6::DOUBLE)::BIGINT END AS tokens_after, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'text' END AS content_type,
    user_id::VARCHAR AS session_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE round(abs(value), 3) END AS duration_ms, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS pii_masked_count
  FROM (SELECT *, (floor(abs(value)) + event_id % 40)::BIGINT AS b FROM events)))"""

QUERIES = {
    "ledger_record": ledger_record, "ledger_summary": ledger_summary, "ledger_latency": ledger_latency, "ledger_by_tool": ledger_by_tool, "ledger_by_type": ledger_by_type, "ledger_sessions": ledger_sessions,
    "ledger_since": ledger_since, "ledger_prune": ledger_prune, "ledger_recent": ledger_recent, "active_sessions": sessions_active, "learn_findings": learn_findings, "decision_record": decision_records,
}
ORACLES = {
    "ledger_record": f"WITH {_LED} SELECT event_id, tokens_before, tokens_after, tokens_saved::BIGINT AS tokens_saved, cost_usd_saved FROM led",
    "ledger_summary": f"""WITH {_LED} SELECT count(*) AS total_calls, sum(tokens_saved)::BIGINT AS tokens_saved, sum(tokens_before)::BIGINT AS tokens_before, sum(tokens_after)::BIGINT AS tokens_after, round(sum(cost_usd_saved), 6) AS cost_usd_saved,
      sum(pii_masked_count)::BIGINT AS pii_masked_count, round(sum(tokens_saved) / sum(tokens_before)::DOUBLE * 100, 2) AS avg_efficiency_pct, round(sum(tokens_saved) * 0.005::DOUBLE, 3) AS energy_mwh_saved, round(sum(tokens_saved) * 0.005::DOUBLE * 0.4::DOUBLE, 3) AS co2_mg_saved FROM led""",
    "ledger_latency": f"WITH {_LED}, s AS (SELECT list_sort(list(duration_ms)) AS d FROM led WHERE duration_ms <> 0) SELECT round(list_avg(d), 1) AS avg_latency_ms, round(d[floor(len(d) * 0.95::DOUBLE)::BIGINT + 1], 1) AS p95_latency_ms, round(d[-1], 1) AS max_latency_ms FROM s",
    "ledger_by_tool": f"WITH {_LED} SELECT tool, sum(tokens_saved)::BIGINT AS tokens_saved FROM led GROUP BY tool",
    "ledger_by_type": f"WITH {_LED} SELECT CASE WHEN content_type = '' THEN 'unknown' ELSE content_type END AS content_type, sum(tokens_saved)::BIGINT AS tokens_saved FROM led GROUP BY 1",
    "ledger_sessions": f"WITH {_LED} SELECT session_id, count(*) AS calls, sum(tokens_saved)::BIGINT AS tokens_saved, sum(tokens_before)::BIGINT AS tokens_before, sum(tokens_after)::BIGINT AS tokens_after, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM led GROUP BY session_id",
    "ledger_since": f"WITH {_LED} SELECT event_id, tokens_saved::BIGINT AS tokens_saved FROM led WHERE ts >= (SELECT max(ts) FROM led) - INTERVAL 7 DAY",
    "ledger_prune": f"WITH {_LED} SELECT tool, count(*) AS n FROM led WHERE ts >= (SELECT max(ts) FROM led) - INTERVAL 3 DAY GROUP BY tool",
    "ledger_recent": f"WITH {_LED} SELECT event_id, tool, tokens_saved::BIGINT AS tokens_saved FROM led ORDER BY ts DESC, event_id DESC LIMIT 20",
    "active_sessions": f"WITH {_LED}, x AS (SELECT session_id, count(*) AS lifetime_calls, count(*) FILTER (ts >= (SELECT max(ts) FROM led) - INTERVAL 10 HOUR) AS recent_calls FROM led GROUP BY session_id) SELECT * FROM x WHERE recent_calls > 0",
    "learn_findings": f"""WITH {_LED}, w AS (SELECT tool, count(*) AS n, avg((tokens_before - tokens_after) / tokens_before::DOUBLE * 100) AS v FROM led WHERE tokens_before > 0 GROUP BY tool), f AS (SELECT 'up' || user_id % 5 AS up, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
      SELECT 'low_efficiency' AS kind, tool AS subject, n, round(v, 6) AS value FROM w WHERE n >= 5 AND v < 15 UNION ALL SELECT 'blocked', '', count(*), 0.0::DOUBLE FROM events WHERE event_type = 'error' HAVING count(*) >= 3
      UNION ALL (SELECT 'failures', up, n, 0.0::DOUBLE FROM f WHERE (SELECT sum(n) FROM f) >= 3 ORDER BY n DESC, up DESC LIMIT 1)""",
    "decision_record": "SELECT sha256('decision:' || doc_id) AS id, doc_id, secret, sha256(CASE WHEN secret IS NOT NULL THEN '[redacted: ' || secret || ']' ELSE text END) AS stored FROM documents JOIN (SELECT id AS doc_id, secret FROM (" + guards.ORACLES["secret_class"] + ") WHERE origin = 'd') USING (doc_id)",
}

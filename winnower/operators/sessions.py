"""Stateful guards and session logic as windows over event time.

A call log is derived from ``events``: session = user_id, tool = event_type,
arguments = props, turn = row number by (ts, event_id) in the session. Every
session's rows are one window partition; sessions are assumed bounded by their
retention, as the state of the streaming twins is.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnower.functions import tokens as T
from winnower.operators.ledger import PRICE
from winnower.sources import tables
from winnower.sources.scratch import cut

MAX_REPEATS, LOOP_WINDOW, TTL = 2, 10, 600
RATE_LIMIT, RATE_SECONDS = 120, 60
BAN_COUNT, BAN_WINDOW, BAN_SECONDS = 8, 600, 7200
QUIET_TURNS = 3
KEEP_OUTPUTS = 3
KEEP_TURNS = 4
CCR_MIN_TOKENS = 15


def fingerprint(tool: str, arguments: str) -> Column:
    """Of a tool and its arguments; JSON objects with their keys sorted."""
    entries = F.array_sort(F.map_entries(F.from_json(arguments, "map<string,string>")))
    plain = F.concat_ws(",", F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return F.sha2(F.concat_ws(":", F.col(tool), F.coalesce(plain, F.col(arguments), F.lit(""))), 256)


def _seconds(ts: str = "ts") -> Column:
    return F.unix_micros(ts)


def loop_guard(calls: DataFrame, session: str, order: list[str], fp: str = "fp", ts: str = "ts", limit: int = MAX_REPEATS, window: int = LOOP_WINDOW, ttl: int = TTL, reset: str | None = None) -> DataFrame:
    """``calls`` with repeat_count and verdict (Allow, Block).

    The streak is the number of calls with the same fingerprint right before this
    one, among the last ``window`` calls of the session that are at most ``ttl``
    seconds old. A row where ``reset`` holds empties the history before it counts.
    """
    w = Window.partitionBy(session).orderBy(*order)
    rows = calls.withColumn("_epoch", F.sum(F.col(reset).cast("int")).over(w) if reset else F.lit(0))
    per = Window.partitionBy(session, "_epoch").orderBy(*order)
    back = F.collect_list(F.struct(F.col(fp).alias("fp"), _seconds(ts).alias("t"))).over(per.rowsBetween(-window, -1))
    rows = rows.withColumn("_back", F.reverse(back))
    same = lambda x: (x["fp"] == F.col(fp)) & (_seconds(ts) - x["t"] <= ttl * 1_000_000)
    # the first element that differs or is too old ends the streak
    flags = F.transform("_back", same)
    stop = F.array_position(flags, F.lit(False))
    streak = F.when(stop > 0, stop - 1).otherwise(F.size(flags))
    return rows.withColumn("repeat_count", (streak + 1).cast("long")).withColumn("verdict", F.when(streak >= limit, "Block").otherwise("Allow")).drop("_back", "_epoch")


def rate_limit(requests: DataFrame, client: str, ts: str = "ts", limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """``requests`` with in_window (calls in the last seconds, this one included) and limited.

    Requests of the same moment see each other.
    """
    w = Window.partitionBy(client).orderBy(_seconds(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("limited", F.col("in_window") > limit)


def auto_ban(offenses: DataFrame, client: str, tie: str, ts: str = "ts", threshold: int = BAN_COUNT, window: int = BAN_WINDOW, ban: int = BAN_SECONDS) -> DataFrame:
    """Rows (client, banned_at, until): an offender's bans; none begins while one holds."""
    w = Window.partitionBy(client).orderBy(_seconds(ts)).rangeBetween(-window * 1_000_000, 0)
    hits = offenses.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= threshold)
    # fold an offender's hits in order; a hit inside a ban begins none
    times = hits.groupBy(client).agg(F.array_sort(F.collect_set(_seconds(ts))).alias("t"))
    long_ = F.lit(ban * 1_000_000)
    bans = F.aggregate("t", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x >= F.element_at(acc, -1) + long_), F.array_append(acc, x)).otherwise(acc))
    out = times.select(client, F.explode(bans).alias("b"))
    return out.select(client, F.timestamp_micros("b").alias("banned_at"), F.timestamp_micros(F.col("b") + long_).alias("until"))


def daily_budget(calls: DataFrame, tokens: str, order: list[str], cap: float, ts: str = "ts") -> DataFrame:
    """``calls`` with the day's spend up to the call, and whether it is over the cap.

    Calls are in order of ``order``, which begins with the time. Sums go over the
    minutes of a day, then over the calls of a minute, so that no task has a whole day.
    """
    day, slot = F.to_date(ts), F.floor(_seconds(ts) / 60_000_000)
    rows = calls.withColumn("day", day).withColumn("_slot", slot)
    slots = rows.groupBy("day", "_slot").agg(F.sum(tokens).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("day").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    # a table of its own, of at most 1,440 rows a day
    slots = cut(slots.select(F.col("day").alias("_day"), F.col("_slot").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before")), "minutes")
    rows = rows.join(slots, F.col("day").eqNullSafe(F.col("_day")) & F.col("_slot").eqNullSafe(F.col("_at")))
    own = F.sum(F.col(tokens)).over(Window.partitionBy("day", "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    spent = (F.col("_before") + F.coalesce(own, F.lit(0))) * F.lit(PRICE)
    return rows.withColumn("spent", F.round(spent, 8)).withColumn("over", F.col("spent") > cap).drop("_slot", "_day", "_at", "_before")


def read_lifecycle(accesses: DataFrame, session: str, path: str, turn: str, op: str, quiet: int = QUIET_TURNS) -> DataFrame:
    """Rows (session, path, status, reads, mature): what the last read of a path is worth.

    stale: written after it; superseded: read more than once since the last write;
    else fresh; unknown: never read. Mature: not fresh, and nothing happened to the
    path in the session's last ``quiet`` turns.
    """
    write, read = F.col(op) == "write", F.col(op) == "read"
    now = accesses.groupBy(session).agg(F.max(turn).alias("now"))
    last = Window.partitionBy(session, path).orderBy(turn)
    rows = accesses.withColumn("_w", F.max(F.when(write, F.col(turn))).over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    g = rows.groupBy(session, path).agg(
        F.max(F.when(read, F.col(turn))).alias("last_read"), F.max("_w").alias("last_write"), F.count_if(read).alias("reads"),
        F.count_if(read & (F.col("_w").isNull() | (F.col(turn) > F.col("_w")))).alias("since"), F.max(turn).alias("last"),
    )
    status = F.when(F.col("last_read").isNull(), "unknown").when(F.col("last_write") > F.col("last_read"), "stale").when(F.col("since") > 1, "superseded").otherwise("fresh")
    g = g.withColumn("status", status).join(now, session)
    mature = F.col("status").isin("stale", "superseded") & (F.col("now") - F.col("last") >= quiet)
    return g.select(session, path, "status", "reads", mature.alias("mature"))


def mask_outputs(outputs: DataFrame, session: str, order: str, text: str = "output", keep: int = KEEP_OUTPUTS) -> tuple[DataFrame, DataFrame]:
    """(outputs with all but the session's last ones masked, table of what was masked by hash)."""
    nth = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    digest = F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 16)
    rows = outputs.withColumn("_n", nth).withColumn("hash", F.when(F.col("_n") > keep, digest))
    note = F.concat(F.lit("[Tool output masked — "), F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(" chars — retrieve with expand_masked_output(hash='"), F.col("hash"), F.lit("')]"))
    masked = rows.withColumn(text, F.when(F.col("hash").isNotNull(), note).otherwise(F.col(text))).drop("_n")
    store = rows.where("hash is not null").select("hash", text).dropDuplicates(["hash"])
    return masked, store


def artifact_index(outputs: DataFrame, tool: str) -> DataFrame:
    """A line for each tool that lists the hashes of what is masked."""
    return outputs.where("hash is not null").groupBy(tool).agg(F.count(F.lit(1)).alias("entries"), F.array_join(F.array_sort(F.collect_list("hash")), ", ").alias("hashes"))


def repeat_diff(calls: DataFrame, keys: list[str], order: list[str], fp: str = "fp", output: str = "output", ts: str = "ts", ttl: int = TTL) -> DataFrame:
    """``calls`` with shown and is_diff: a diff to the last output of the same call, if it is shorter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.lag(F.struct(F.col(fp).alias("fp"), F.col(output).alias("out"), _seconds(ts).alias("t"))).over(w)
    rows = calls.withColumn("_last", last)
    usable = (F.col("_last.fp") == F.col(fp)) & (_seconds(ts) - F.col("_last.t") <= ttl * 1_000_000)

    @F.pandas_udf("string")
    def diff(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="")) for a, b in zip(before, after, strict=True)])

    rows = rows.withColumn("_diff", diff(F.when(usable, F.col("_last.out")), F.col(output)))
    short = F.coalesce((F.col("_diff") != "") & (F.length("_diff") < F.length(output)), F.lit(False))
    return rows.withColumn("shown", F.when(short, F.col("_diff")).otherwise(F.col(output))).withColumn("is_diff", short).drop("_last", "_diff")


def conversation_split(messages: DataFrame, conv: str, turn: str, keep: int = KEEP_TURNS) -> DataFrame:
    """``messages`` with verbatim: whether it is one of the last; where there are no more than ``keep``, none is."""
    w = Window.partitionBy(conv)
    n = F.count(F.lit(1)).over(w)
    back = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    return messages.withColumn("_n", n).withColumn("verbatim", (back <= (keep or KEEP_TURNS)) & (F.col("_n") > (keep or KEEP_TURNS))).drop("_n")


def history_split(messages: DataFrame, conv: str, turn: str) -> DataFrame:
    """``messages`` with the level at which a rolling history is compressed.

    Six messages or more: the last half, two at least, at the default level, the
    older ones harder; shorter histories have one level. Texts under 20 characters stay.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(conv))
    back = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    level = F.when(F.length("text") < 20, "none").when((n >= 6) & (back > F.greatest(F.lit(2), F.floor(n / 2))), "aggressive").otherwise("semantic")
    return messages.withColumn("level", level)


def ccr(texts: DataFrame, original: str, compressed: str) -> tuple[DataFrame, DataFrame]:
    """(texts with a retrieval mark where 15 tokens or more were saved, table token → original)."""
    token = F.substring(F.sha2(F.col(original), 256), 1, 12)
    worth = T.chars_count(original) - T.chars_count(compressed) >= CCR_MIN_TOKENS
    rows = texts.withColumn("token", F.when(worth, token)).withColumn("marked", F.when(worth, F.concat(F.col(compressed), F.lit(" [ccr:"), token, F.lit("]"))).otherwise(F.col(compressed)))
    return rows, rows.where("token is not null").select("token", F.col(original).alias("original")).dropDuplicates(["token"])


def calls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("turn", turn).withColumn("fp", fingerprint("event_type", "props"))


def loop_guard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session is ten users' calls, a fingerprint the tool alone: there are streaks to find."""
    c = calls_of(spark, sf_dir).withColumn("session", F.pmod("user_id", F.lit(10))).withColumn("fp", F.sha2("event_type", 256))
    return loop_guard(c, "session", ["ts", "event_id"], ttl=86_400).select("event_id", "repeat_count", "verdict")


def loop_guard_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls_of(spark, sf_dir).withColumn("session", F.pmod("user_id", F.lit(10))).withColumn("fp", F.sha2("event_type", 256)).withColumn("reset", F.col("event_type") == "purchase")
    return loop_guard(c, "session", ["ts", "event_id"], ttl=86_400, reset="reset").select("event_id", "repeat_count", "verdict")


def rate_limit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rate_limit(e, "user_id", limit=2, seconds=86_400).select("event_id", "in_window", "limited")


def auto_ban_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ip", F.pmod("user_id", F.lit(20)))
    b = auto_ban(e, "ip", "event_id", threshold=3, window=86_400, ban=172_800)
    return b.select("ip", F.date_format("banned_at", "yyyy-MM-dd HH:mm:ss").alias("banned_at"), F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"))


def daily_budget_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls_of(spark, sf_dir).withColumn("tokens", F.floor(F.abs("value")).cast("long"))
    return daily_budget(c, "tokens", ["ts", "event_id"], 0.005).select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "spent", "over")


def read_lifecycle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls_of(spark, sf_dir).where("event_type in ('click', 'view', 'purchase')")
    c = c.withColumn("op", F.when(F.col("event_type") == "purchase", "write").otherwise("read")).withColumn("path", F.concat(F.lit("f"), F.pmod("event_id", F.lit(3))))
    return read_lifecycle(c, "user_id", "path", "turn", "op")


def mask_old_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked, _ = mask_outputs(tables.read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return masked.select("conv_id", "turn", "text", "hash")


def artifact_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked, _ = mask_outputs(tables.read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return artifact_index(masked, "role")


def repeat_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations").withColumn("fp", F.col("role")).withColumn("ts", F.timestamp_seconds("turn"))
    return repeat_diff(c, ["conv_id", "role"], ["turn"], output="text").select("conv_id", "turn", "is_diff", F.length("shown").alias("chars"))


def conversation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_split(tables.read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "verbatim")


def history_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_split(tables.read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "level")


def ccr_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").withColumn("short", F.substring_index("text", "\n", 1))
    return ccr(d, "text", "short")[0].select("doc_id", "token", "marked")


_CALLS = "calls AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)"
_STREAK = """x AS (SELECT *, row_number() OVER (PARTITION BY s, ep ORDER BY ts, event_id) AS n FROM c), y AS (SELECT *, coalesce(lag(event_type) OVER w <> event_type, true) AS fresh FROM x WINDOW w AS (PARTITION BY s, ep ORDER BY n)),
  z AS (SELECT *, max(CASE WHEN fresh THEN n END) OVER (PARTITION BY s, ep ORDER BY n) AS start FROM y),
  k AS (SELECT a.event_id, count(b.event_id) AS old FROM z a JOIN z b ON a.s = b.s AND a.ep = b.ep AND b.n < a.n AND b.n >= a.start AND b.n >= a.n - 10 AND a.ts - b.ts <= INTERVAL 86400 SECOND GROUP BY a.event_id)
  SELECT z.event_id, coalesce(old, 0) + 1 AS repeat_count, CASE WHEN coalesce(old, 0) >= 2 THEN 'Block' ELSE 'Allow' END AS verdict FROM z LEFT JOIN k USING (event_id)"""

QUERIES = {
    "loop_guard": loop_guard_query, "loop_guard_reset": loop_guard_reset, "rate_limit": rate_limit_query, "auto_ban": auto_ban_query, "daily_budget": daily_budget_query, "read_lifecycle": read_lifecycle_query,
    "mask_old_outputs": mask_old_outputs, "artifact_index": artifact_index_query, "repeat_diff": repeat_diff_query, "conversation_tail": conversation_tail, "history_levels": history_levels, "ccr_marks": ccr_marks,
}
_MASK = "SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3 THEN sha256(text)[1:16] END AS hash FROM conversations"
ORACLES = {
    "loop_guard": f"WITH c AS (SELECT *, user_id % 10 AS s, 0 AS ep FROM events), {_STREAK}",
    "loop_guard_reset": f"WITH c AS (SELECT *, user_id % 10 AS s, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS ep FROM events), {_STREAK}",
    "rate_limit": "SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 2 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)",
    "auto_ban": """WITH RECURSIVE h AS (SELECT DISTINCT ip, ts FROM (SELECT user_id % 20 AS ip, ts, count(*) OVER (PARTITION BY user_id % 20 ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') WHERE n >= 3),
      b AS (SELECT ip, min(ts) AS t FROM h GROUP BY ip UNION ALL SELECT b.ip, (SELECT min(ts) FROM h WHERE h.ip = b.ip AND h.ts >= b.t + INTERVAL 172800 SECOND) FROM b WHERE b.t IS NOT NULL)
      SELECT ip, strftime(t, '%Y-%m-%d %H:%M:%S') AS banned_at, strftime(t + INTERVAL 172800 SECOND, '%Y-%m-%d %H:%M:%S') AS until FROM b WHERE t IS NOT NULL""",
    "daily_budget": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, round(s, 8) AS spent, round(s, 8) > 0.005 AS over FROM (SELECT *, sum(floor(abs(value))::BIGINT) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 3e-6::DOUBLE AS s FROM events)",
    "read_lifecycle": f"""WITH {_CALLS}, a AS (SELECT user_id, 'f' || event_id % 3 AS path, turn, event_type = 'purchase' AS w FROM calls WHERE event_type IN ('click', 'view', 'purchase')),
      n AS (SELECT user_id, max(turn) AS now FROM a GROUP BY user_id), lw AS (SELECT user_id, path, max(turn) FILTER (w) AS lw FROM a GROUP BY ALL),
      g AS (SELECT user_id, path, max(turn) FILTER (NOT w) AS lr, any_value(lw) AS lw, count(*) FILTER (NOT w) AS reads, count(*) FILTER (NOT w AND (lw IS NULL OR turn > lw)) AS since, max(turn) AS last FROM a JOIN lw USING (user_id, path) GROUP BY ALL),
      s AS (SELECT *, CASE WHEN lr IS NULL THEN 'unknown' WHEN lw > lr THEN 'stale' WHEN since > 1 THEN 'superseded' ELSE 'fresh' END AS status FROM g)
      SELECT user_id, path, status, reads, status IN ('stale', 'superseded') AND now - last >= 3 AS mature FROM s JOIN n USING (user_id)""",
    "mask_old_outputs": f"SELECT conv_id, turn, CASE WHEN hash IS NULL THEN text ELSE '[Tool output masked — ' || length(text) || ' chars — retrieve with expand_masked_output(hash=''' || hash || ''')]' END AS text, hash FROM ({_MASK})",
    "artifact_index": f"SELECT role, count(*) AS entries, string_agg(hash, ', ' ORDER BY hash) AS hashes FROM ({_MASK}) WHERE hash IS NOT NULL GROUP BY role",
    "conversation_tail": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4 AND count(*) OVER (PARTITION BY conv_id) > 4 AS verbatim FROM conversations",
    "history_levels": "SELECT conv_id, turn, CASE WHEN length(text) < 20 THEN 'none' WHEN n >= 6 AND b > greatest(2, n // 2) THEN 'aggressive' ELSE 'semantic' END AS level FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)",
    "ccr_marks": "SELECT doc_id, CASE WHEN length(text) // 4 - length(s) // 4 >= 15 THEN sha256(text)[1:12] END AS token, CASE WHEN length(text) // 4 - length(s) // 4 >= 15 THEN s || ' [ccr:' || sha256(text)[1:12] || ']' ELSE s END AS marked FROM (SELECT *, split_part(text, chr(10), 1) AS s FROM documents)",
}

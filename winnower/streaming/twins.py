"""Structured Streaming twins of the guards over an event stream.

Time is event time. Rows later than the watermark are dropped. State is bounded:
a session keeps its last calls, a client the times inside its window, and both are
given up when the watermark has passed the time from which they count no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from winnower.operators.sessions import LOOP_WINDOW, MAX_REPEATS, RATE_LIMIT, RATE_SECONDS, TTL
from winnower.sources.scratch import BATCH_ROWS, scratch

LATE = "1 hour"
FAILURES, FAILURE_SECONDS, OPEN_SECONDS = 3, 60, 30
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream, with their time as an instant."""
    e = spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and read its sink, files in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def session_windows(stream: DataFrame, gap: str = "300 seconds") -> DataFrame:
    """Rows (user_id, start, end, calls) of sessions that end after a gap."""
    return stream.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("calls")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def minute_rates(stream: DataFrame, seconds: int = RATE_SECONDS, limit: int = RATE_LIMIT) -> DataFrame:
    """Rows (user_id, start, calls) of tumbling windows over the limit."""
    w = stream.withWatermark("ts", LATE).groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return w.where(F.col("calls") > limit).select("user_id", F.col("w.start").alias("start"), "calls")


def once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first of rows with equal keys inside the watermark."""
    return stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def _micros(ts: pd.Series) -> np.ndarray:
    return pd.to_datetime(ts).dt.as_unit("us").astype("int64").to_numpy()


def _in_time(frames: Iterator[pd.DataFrame], state: GroupState, column: str | None = None) -> tuple[Iterator[tuple[int, int, int]] | None, list]:
    """The rows (event_id, time, code) of a batch in order (None: there are none), without those behind the watermark (Spark's own filter lags it by a batch), and what the codes of ``column`` mean.

    A key's rows of a batch are held as numbers, a few dozen bytes each.
    """
    late = state.getCurrentWatermarkMs() * 1000
    codes: dict[object, int] = {}
    parts = []
    for f in frames:
        t = _micros(f["ts"])
        f, t = f[t >= late], t[t >= late]
        own = np.zeros(len(f), dtype=np.int32)
        if column and len(f):
            at, names = pd.factorize(f[column], use_na_sentinel=False)
            own = np.array([codes.setdefault(None if x != x else x, len(codes)) for x in names.tolist()], dtype=np.int32)[at]
        parts.append((f["event_id"].to_numpy(dtype=np.int64), t, own))
    events, times, own = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((events, times))

    def rows() -> Iterator[tuple[int, int, int]]:
        for i in range(0, len(order), BATCH_ROWS):
            o = order[i : i + BATCH_ROWS]
            yield from zip(events[o].tolist(), times[o].tolist(), own[o].tolist(), strict=True)

    return rows() if len(order) else None, list(codes)


def _in_parts(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, BATCH_ROWS)):
        yield pd.DataFrame(part, columns=columns)


def _until(state: GroupState, micros: int) -> None:
    """Give the state up when the watermark passes a time."""
    state.setTimeoutTimestamp(max(micros // 1000, state.getCurrentWatermarkMs()) + 1)


def loop_streaks(stream: DataFrame, session: str, fp: str, limit: int = MAX_REPEATS, window: int = LOOP_WINDOW, ttl: int = TTL) -> DataFrame:
    """Rows (event_id, repeat_count, verdict), as the batch form gives them."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = list(zip(*state.get, strict=True)) if state.exists else []
        rows, names = _in_time(frames, state, "fp")
        if rows is None and not state.exists:
            return

        def told() -> Iterator[tuple]:
            nonlocal past
            for event, t, code in rows or ():
                print_, streak = names[code], 0
                for p, at in reversed(past):
                    if p != print_ or t - at > ttl * 1_000_000:
                        break
                    streak += 1
                past = [*past, (print_, t)][-window:]
                yield event, streak + 1, "Block" if streak >= limit else "Allow"

        yield from _in_parts(told(), ["event_id", "repeat_count", "verdict"])
        state.update(([p for p, _ in past], [t for _, t in past]))
        _until(state, past[-1][1] + ttl * 1_000_000)

    rows = stream.withWatermark("ts", LATE).select(F.col(session).cast("string").alias("session"), F.col(fp).alias("fp"), "ts", "event_id")
    return rows.groupBy("session").applyInPandasWithState(fold, "event_id long, repeat_count long, verdict string", "fps array<string>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_hits(stream: DataFrame, client: str, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """Rows (event_id, in_window, limited): requests of a client in the last seconds, in order of (ts, event_id)."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = list(state.get[0]) if state.exists else []
        rows, _ = _in_time(frames, state)
        if rows is None and not state.exists:
            return

        def told() -> Iterator[tuple]:
            nonlocal past
            for event, t, _ in rows or ():
                past = [x for x in past if x >= t - seconds * 1_000_000] + [t]
                yield event, len(past), len(past) > limit

        yield from _in_parts(told(), ["event_id", "in_window", "limited"])
        state.update((past,))
        _until(state, past[-1] + seconds * 1_000_000)

    rows = stream.withWatermark("ts", LATE).select(F.col(client).cast("string").alias("client"), "ts", "event_id")
    return rows.groupBy("client").applyInPandasWithState(fold, "event_id long, in_window long, limited boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class Breaker:
    """A circuit breaker's fold: failures inside a window open it for a while; a success clears them."""

    def __init__(self, failures: list[int] | None = None, open_until: int = 0) -> None:
        self.failures, self.open_until = failures or [], open_until

    def see(self, t: int, failed: bool) -> str:
        if t < self.open_until:
            return "open"
        if not failed:
            self.failures = []
            return "closed"
        self.failures = [x for x in self.failures if x >= t - FAILURE_SECONDS * 1_000_000] + [t]
        if len(self.failures) >= FAILURES:
            self.failures, self.open_until = [], t + OPEN_SECONDS * 1_000_000
            return "tripped"
        return "closed"


def breakers(stream: DataFrame, upstream: str, failed: str) -> DataFrame:
    """Rows (event_id, state): what an upstream's breaker was at each call."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b = Breaker(list(state.get[0]), state.get[1]) if state.exists else Breaker()
        rows, names = _in_time(frames, state, "failed")
        if rows is None and not state.exists:
            return
        yield from _in_parts(((e, b.see(t, bool(names[code]))) for e, t, code in rows or ()), ["event_id", "state"])
        state.update((b.failures, b.open_until))
        _until(state, max([b.open_until, *(t + FAILURE_SECONDS * 1_000_000 for t in b.failures)]))

    rows = stream.withWatermark("ts", LATE).select(F.col(upstream).cast("string").alias("upstream"), F.col(failed).alias("failed"), "ts", "event_id")
    return rows.groupBy("upstream").applyInPandasWithState(fold, "event_id long, state string", "failures array<long>, open_until long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of a stream of which all is there: complete counts, in update mode's final state."""
    s = events(spark, sf_dir).withWatermark("ts", LATE).groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    out = run_available(s.select("user_id", F.col("w.start").alias("start"), "calls"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "calls")


def stream_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user that end after a day without events."""
    s = events(spark, sf_dir).withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    out = run_available(s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls"), "complete")
    return out.select("user_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")), "calls")


def stream_loop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("session", F.pmod("user_id", F.lit(10))).withColumn("fp", F.sha2("event_type", 256))
    return run_available(loop_streaks(e, "session", "fp", ttl=86_400))


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(rate_hits(events(spark, sf_dir), "user_id", 2, 86_400))


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("upstream", F.pmod("user_id", F.lit(5))).withColumn("failed", F.col("event_type") == "error")
    return run_available(breakers(e, "upstream", "failed"))


from winnower.operators import sessions as _batch  # noqa: E402

QUERIES = {"stream_sessions": stream_sessions, "stream_session_windows": stream_session_windows, "stream_loop_guard": stream_loop_guard, "stream_rate_limit": stream_rate_limit, "stream_breaker": stream_breaker}
ORACLES = {
    "stream_sessions": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls FROM events GROUP BY ALL",
    "stream_session_windows": """WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY, true)::INT AS fresh FROM events WHERE ts IS NOT NULL),
      s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS calls FROM s GROUP BY user_id, n""",
    "stream_breaker": f"""WITH RECURSIVE e AS (SELECT event_id, user_id % 5 AS u, epoch_us(ts) AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS k FROM events),
      r AS (SELECT u, 0::BIGINT AS k, NULL::BIGINT AS event_id, []::BIGINT[] AS past, 0::BIGINT AS until, 'closed' AS state FROM (SELECT DISTINCT u FROM e)
        UNION ALL SELECT e.u, e.k, e.event_id,
          CASE WHEN e.t < r.until THEN r.past WHEN NOT e.failed THEN [] WHEN len(list_filter(r.past, lambda x: x >= e.t - {FAILURE_SECONDS * 1_000_000})) >= {FAILURES - 1} THEN [] ELSE list_append(list_filter(r.past, lambda x: x >= e.t - {FAILURE_SECONDS * 1_000_000}), e.t) END,
          CASE WHEN e.t >= r.until AND e.failed AND len(list_filter(r.past, lambda x: x >= e.t - {FAILURE_SECONDS * 1_000_000})) >= {FAILURES - 1} THEN e.t + {OPEN_SECONDS * 1_000_000} ELSE r.until END,
          CASE WHEN e.t < r.until THEN 'open' WHEN e.failed AND len(list_filter(r.past, lambda x: x >= e.t - {FAILURE_SECONDS * 1_000_000})) >= {FAILURES - 1} THEN 'tripped' ELSE 'closed' END
        FROM r JOIN e ON e.u = r.u AND e.k = r.k + 1)
      SELECT event_id, state FROM r WHERE event_id IS NOT NULL""",
    "stream_loop_guard": _batch.ORACLES["loop_guard"],
    "stream_rate_limit": "SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 2 AS limited FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)",
}

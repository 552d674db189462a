"""State that ends, rows that come too late, and sums in parts."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnower.operators import privacy, sessions, structured
from winnower.streaming import twins


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def run(spark, tmp_path, parts, make):
    """Stream the parts as one file each, a batch a file; the rows and the states left at the end."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(parts):
        frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        frame["ts"] = frame["ts"].astype("datetime64[us]")
        frame.to_parquet(folder / f"part{k}.parquet")
        # files are read in the order of their age
        import os

        os.utime(folder / f"part{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    e = spark.readStream.schema(twins.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    q = make(e).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect(), q.recentProgress[-1].stateOperators[0].numRowsTotal


def event(k, ts, user, kind="a"):
    return (k, ts, user, kind, 1.0, "{}")


PARTS = [
    [event(1, at(10), 1, "error"), event(2, at(10, 1), 1, "error")],
    [event(3, at(14), 2, "error")],
    # too late by the watermark of 13:00, and in time
    [event(4, at(10, 2), 1, "error"), event(5, at(14, 1), 2, "error")],
    [event(6, at(14, 2), 3, "error")],
]


@pytest.mark.parametrize("make", [
    lambda e: twins.rate_hits(e, "user_id", 1, 60), lambda e: twins.loop_streaks(e, "user_id", "event_type", ttl=60), lambda e: twins.breakers(e.withColumn("failed", F.lit(True)), "user_id", "failed"),
], ids=["rate", "loop", "breaker"])
def test_keys_expire_and_late_rows_go(spark, tmp_path, make):
    rows, states = run(spark, tmp_path, PARTS, make)
    assert sorted(r.event_id for r in rows) == [1, 2, 3, 5, 6]
    # user 1 was last seen hours before the watermark: its state is gone
    assert states == 2


def test_sums_of_a_day_in_parts(spark):
    rows = [(k, at(9, k % 3) + dt.timedelta(seconds=k), 10 * k) for k in range(60)] + [(100, None, 5), (101, at(9), 7)]
    got = {r.k: (r.spent, r.over) for r in sessions.daily_budget(spark.createDataFrame(rows, "k long, ts timestamp, tokens long"), "tokens", ["ts", "k"], 0.01).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, ts, _ in rows:
        if ts is not None:
            spent = sum(n for j, t, n in rows if t is not None and (t, j) <= (ts, k))
            assert got[k] == (pytest.approx(spent * sessions.PRICE, abs=1e-8), round(spent * sessions.PRICE, 8) > 0.01)


def test_vaults_are_renumbered_in_order(spark):
    rows = [("s", n, f"[PG_{n}]", v, "c") for n, v in [(1, "bb"), (1, "ab"), (2, "bb"), (2, "aa"), (1, "abcd"), (1, "abca")]] + [(None, 1, "[PG_1]", "x", "c")]
    got = privacy.merge_vaults(spark.createDataFrame(rows, "session_id string, n int, placeholder string, original_value string, category string"))
    assert sorted((r.session_id or "", r.n, r.original_value) for r in got.collect()) == [("", 1, "x"), ("s", 1, "ab"), ("s", 2, "abca"), ("s", 3, "abcd"), ("s", 4, "bb"), ("s", 5, "aa")]


def test_long_texts_are_routed_harder(spark):
    rows = "[" + ", ".join(f'{{"id": {k}, "name": "entry number {k}", "note": "{"x" * 60}{k}"}}' for k in range(400)) + "]"
    words = "The quick service is usually reliable and the beautiful network remains available. "
    texts = [("short json", rows[: rows.index("}, ", 2000) + 1] + "]"), ("long json", rows), ("short", words * 20), ("long", words * 300)]
    got = {r.k: r for r in structured.route(spark.createDataFrame(texts, "k string, text string"), "text", "balanced").collect()}
    assert got["short"].type == got["long"].type == "PlainText"
    per = {k: len(got[k].routed.split()) / len(t.split()) for k, t in texts}
    assert per["long"] < per["short"]


def test_a_key_of_many_rows_is_held_as_numbers():
    """300,000 rows of one key in frames of 10,000: what is held grows by less than 100 bytes a row, and rows come in order."""
    import tracemalloc

    class State:
        def getCurrentWatermarkMs(self):  # noqa: N802
            return 0

    base, n = pd.Timestamp("2024-01-01"), 300_000

    def frames():
        for i in range(0, n, 10_000):
            k = pd.Series(range(i, i + 10_000))
            yield pd.DataFrame({"event_id": k, "ts": base + pd.to_timedelta(n - k, unit="s"), "fp": (k % 5).map(lambda x: f"{x:064d}")})

    tracemalloc.start()
    rows, names = twins._in_time(frames(), State(), "fp")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n and len(names) == 5
    got = list(rows)
    assert [r[0] for r in got] == list(range(n - 1, -1, -1)) and all(names[r[2]] == f"{r[0] % 5:064d}" for r in got[:50])

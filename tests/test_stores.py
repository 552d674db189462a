"""Ledgers that are migrated, exported, pruned and reset; sessions and caches that expire."""

import datetime as dt
import json

from pyspark.sql import functions as F

from winnower.operators import ledger
from winnower.sources import stores

NOW = dt.datetime(2024, 5, 1, 12)


def test_migration_happens_once(spark, tmp_path):
    old, new = str(tmp_path / "ledger.json"), str(tmp_path / "ledger.jsonl")
    (tmp_path / "ledger.json").write_text(json.dumps([{"tool": "a", "tokens_saved": 3}, {"tool": "b"}]))
    assert stores.migrate_json_array(spark, old, new) and not (tmp_path / "ledger.json").exists()
    assert sorted((r.tool, r.tokens_saved) for r in stores.read_jsonl(spark, new).collect()) == [("a", 3), ("b", None)]
    (tmp_path / "ledger.json").write_text("[]")
    assert not stores.migrate_json_array(spark, old, new) and stores.read_jsonl(spark, new).count() == 2
    assert not stores.migrate_json_array(spark, str(tmp_path / "none"), str(tmp_path / "other"))


def test_export_has_all_keys_in_order(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"b": 1, "a": "x, y"}\n\n{"c": true, "b": null}\n')
    stores.export_all_keys(spark, str(tmp_path / "l.jsonl"), str(tmp_path / "csv"))
    got = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert got.columns == ["b", "a", "c"] and sorted(map(str, map(tuple, got.collect()))) == ["('1', 'x, y', None)", "(None, None, 'true')"]


def test_delete_reset_and_list(spark):
    rows = [(1, "s1", NOW), (2, "s2", NOW + dt.timedelta(hours=1)), (3, None, NOW), (4, "s1", None)]
    df = spark.createDataFrame(rows, "id long, session_id string, ts timestamp")
    assert sorted(r.id for r in ledger.without_session(df, "s1").collect()) == [2, 3]
    assert ledger.emptied(df).count() == 0 and ledger.emptied(df).columns == df.columns
    assert [r.id for r in ledger.decisions(df, 2).collect()] == [2, 3]


def test_sessions_are_added_up_and_expire(spark):
    calls = spark.createDataFrame([("a", NOW, 5), ("a", NOW + dt.timedelta(minutes=2), None), ("b", NOW - dt.timedelta(hours=1), 1)], "session_id string, ts timestamp, tokens_saved long")
    known = stores.calls_by_session(calls)
    both = stores.calls_by_session(calls.where("session_id = 'a'"), known)
    got = {r.session_id: (r.call_count, r.tokens_saved, r.last_seen) for r in both.collect()}
    assert got == {"a": (4, 10, NOW + dt.timedelta(minutes=2)), "b": (1, 1, NOW - dt.timedelta(hours=1))}
    assert [r.session_id for r in stores.expired(both, F.lit(NOW), 300).collect()] == ["b"]


def test_caches_expire_and_are_bounded(spark, tmp_path):
    cache = stores.MemoryTable(spark, str(tmp_path / "cache"), 60, 2)
    rows = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    keys = rows(("a", ""), ("b", ""), ("c", ""))
    assert cache.get(keys, NOW).count() == 0
    cache.put(rows(("a", "1")), NOW)
    cache.put(rows(("a", "2"), ("b", "3")), NOW + dt.timedelta(seconds=10))
    assert sorted(map(tuple, cache.get(keys, NOW + dt.timedelta(seconds=20)).collect())) == [("a", "2"), ("b", "3")]
    cache.put(rows(("c", "4")), NOW + dt.timedelta(seconds=30))
    assert sorted(map(tuple, cache.get(keys, NOW + dt.timedelta(seconds=40)).collect())) == [("b", "3"), ("c", "4")]
    assert sorted(map(tuple, cache.get(keys, NOW + dt.timedelta(seconds=80)).collect())) == [("c", "4")]

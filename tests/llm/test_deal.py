"""Mixing, packing and the pipeline: rare sources, repeated rows, columns of any name."""

import hashlib
import itertools
import math
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from winnower.llm import common, jpeg, langid, linededup, minhash, mixing, packing, pii

ODD_NAMES = ["_source", "_rate", "_cdf", "_own", "_shard", "a.b", "tick`ed", "Score", "N_LINES", "copy", "rate", "key", "own", "size", "hits", "drops", "done", "name", "n"]


@pytest.fixture
def named(spark):
    """Documents with columns named like helpers and results, and a row that repeats."""
    rows = [(i, f"first line of all\nand the next line of {i}", "en" if i % 2 else "fr", f"s{i % 3}", *(f"{c} {i}" for c in ODD_NAMES)) for i in (0, 1, 2, 3, 4, 4)]
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *ODD_NAMES]), schema


@pytest.mark.parametrize("work", [linededup.dedup_lines, mixing.mix, packing.pack, pii.pseudonymise, lambda d: langid.identify(d, None), minhash.keep_one, lambda d: jpeg.media_features(jpeg.store_texts(d))], ids=["lines", "mixing", "packing", "pii", "language", "minhash", "media"])
def test_columns_of_any_name(named, work):
    work(named[0]).collect()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_leave_other_columns_alone(spark, named, stage):
    docs = named[0]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[c] == f"{c} {r.doc_id}" for c in ODD_NAMES)
    assert stage(spark, docs.where("false"), "").count() == 0


def test_stages_on_nulls_empty_and_long_texts(spark):
    long_ = " ".join(f"wort{k}" for k in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n", "en", "a"), (None, "some words without any id", None, "a"), (4, long_, "de", "b"), (5, long_, "de", "b"), (6, "the words of a text", "en", None), (6, "the words of a text", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(str(r.doc_id) for r in stages["language"](spark, docs, "").collect()) == ["4", "5", "6", "6", "None"]
    assert sorted(str(r.doc_id) for r in stages["lines"](spark, docs, "").collect()) == sorted(str(r[0]) for r in rows)
    # the copy with the greater id loses its one line, as text and all
    assert {r.doc_id: len(r.text or "") for r in stages["lines"](spark, docs, "").where("doc_id > 3").collect()} == {4: len(long_), 5: 0, 6: 19}
    assert sorted(str(r.doc_id) for r in stages["near_duplicates"](spark, docs, "").collect()) == ["1", "2", "3", "4", "6", "6", "None"]
    assert {r.source for r in stages["mixture"](spark, docs, "").collect()} <= {"a", "b", None}
    packed = stages["batches"](spark, docs, "").collect()
    assert len(packed) == len(rows) and len({(r.batch_id, r.slot) for r in packed}) == len(rows)
    assert stages["batches"](spark, docs.drop("source"), "").columns == ["doc_id", "n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding"]


def test_without_labels_documents_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "123", None), (3, None, None), (4, "слово", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 4]


def test_undecided_documents_go(spark, monkeypatch):
    # two languages of equal texts: no letter tells them apart
    rows = [(i, "aaa bbb ccc", ("xx", "yy")[i % 2]) for i in range(200)] + [(1000 + i, "zzz qqq", "xx") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.text for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert "zzz qqq" in kept
    monkeypatch.setattr(corpus_pipeline, "MIN_LIFT", 1.5)
    assert {r.text for r in corpus_pipeline.language(spark, docs, "").collect()} == {"zzz qqq"}


def test_pipeline_equals_its_stages_by_brute_force(spark, data):
    """Each stage's decision, recomputed from what it was given."""
    stages = dict(corpus_pipeline.STAGES)
    docs = common.materialise(stages["language"](spark, common.table(spark, data, "documents"), data), "t")
    given = {r.doc_id: r.text for r in docs.collect()}
    lines = common.materialise(stages["lines"](spark, docs, data), "t")
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in t.split("\n")]
    first = {}
    for i in sorted(given):
        for k in keys(given[i]):
            if len(k) >= 10:
                first.setdefault(k, []).append(i)
    want = {i: "\n".join(x for x, k in zip(t.split("\n"), keys(t), strict=True) if len(k) < 10 or len(set(first[k])) < 2 or first[k][0] == i) for i, t in given.items()}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    sets = {}
    for i, t in want.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) if x]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for a, b in {(a, b) for h in holders.values() for a, b in itertools.combinations(sorted(h), 2)}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    unique = common.materialise(stages["near_duplicates"](spark, lines, data), "t")
    assert {r.doc_id for r in unique.collect()} == {i for i in sets if find(i) == i}
    mixed = common.materialise(stages["mixture"](spark, unique, data), "t")
    rows = unique.select("doc_id", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    expected = {}
    for r in rows:
        rate, u = len(rows) / len(sizes) / sizes[r.source], int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        if k:
            expected[r.doc_id] = k
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == expected
    packed = stages["batches"](spark, mixed, data).collect()
    assert sum(expected.values()) == len(packed) and len({(r.batch_id, r.slot) for r in packed}) == len(packed)
    assert all(r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", want[r.doc_id])) for r in packed)


# --- mixing -----------------------------------------------------------------------------


def test_very_rare_sources(spark):
    df = spark.range(1_000_000).select((F.col("id") + 1).alias("doc_id"), F.when(F.col("id") == 7, "rare").otherwise("common").alias("source"))
    out = mixing.mix(df, {"rare": 1.0, "common": 1.0})
    rare = out.where("source = 'rare'").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("copies"), F.max("rate").alias("rate")).first()
    assert rare.rate == 500_000 and abs(rare.n - 500_000) < 6 * math.sqrt(500_000) and rare.copies == rare.n


def test_rates_in_parts_are_poisson(spark):
    df = spark.range(4000).select("id", F.col("id").alias("doc_id"), F.when(F.col("id") < 10, "a").otherwise("b").alias("source"))
    n = [r["count"] for r in mixing.mix(df.where("id < 10 or id >= 0"), {"a": 1.0}).groupBy("doc_id").count().collect()]
    assert len(n) == 10 and abs(sum(n) - 4000) < 6 * math.sqrt(4000) and len(set(n)) > 5


def test_rows_without_an_id_draw_apart(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    out = mixing.mix(df, {"a": 1.0, "b": 3.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 500) < 150 and abs(n["b"] - 1500) < 250
    assert out.select("shuffle_key").distinct().count() > 1500


# --- packing ----------------------------------------------------------------------------


def padding(tops, hist):
    return sum((min(t for t in tops if t >= n) - n) * rows for n, rows in hist)


@pytest.mark.parametrize("buckets", [2, 7, 16])
def test_boundaries_of_long_texts_are_optimal(buckets):
    rng = random.Random(buckets)
    hist = sorted({rng.randrange(1, 20_000) if rng.random() < 0.7 else rng.randrange(500, 530): rng.randrange(1, 50) for _ in range(300)}.items())
    below = list(itertools.accumulate((rows for _, rows in hist), initial=0))
    best = [0] + [math.inf] * len(hist)
    for _ in range(buckets):
        best = [0] + [min(best[i] + hist[j - 1][0] * (below[j] - below[i]) for i in range(j)) for j in range(1, len(hist) + 1)]
    tops = packing.boundaries(hist, buckets)
    assert len(tops) <= buckets and padding(tops, hist) == best[-1] - sum(n * rows for n, rows in hist)


def test_histogram_is_exact(spark):
    df = spark.range(1, 30_000).select((F.col("id") * 7 % 9_000).alias("n_tokens"))
    hist = packing.histogram(df)
    assert hist == sorted(hist) and len(hist) == 9_000 and sum(r for _, r in hist) == 29_999


def test_batches_do_not_depend_on_the_partitioning(spark, data):
    docs = common.table(spark, data, "documents").select("doc_id", "text")
    docs = docs.unionAll(docs.where("doc_id % 7 = 0")).unionAll(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    once = sorted(map(str, packing.pack(docs, budget=4096, shard_rows=50).drop("text").collect()))
    again = sorted(map(str, packing.pack(docs.repartition(7, "text"), budget=4096, shard_rows=50).drop("text").collect()))
    assert once == again


def test_equal_rows_are_spread_over_shards(spark):
    df = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("a b c").alias("text"))
    first, second = (packing.pack(d, budget=30, shard_rows=100).collect() for d in (df, df.repartition(5)))
    assert sorted(map(str, first)) == sorted(map(str, second)) and len({(r.batch_id, r.slot) for r in first}) == 3000
    sizes = {}
    for r in first:
        sizes[r.batch_id.rsplit("-", 1)[0]] = sizes.get(r.batch_id.rsplit("-", 1)[0], 0) + 1
    assert len(sizes) > 15 and max(sizes.values()) <= 400

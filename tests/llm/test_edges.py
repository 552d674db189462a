"""Nulls, empty tables, repeated rows and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from winnower.llm import embdedup, jpeg, langid, linededup, minhash, mixing, packing, pii, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, copy string, lang_pred string, bucket string, pii_counts string"
ODD = [
    (1, "hello there my dear friends of old", "en", "a", 3, "x", "x", "x", "x", "x"),
    (1, "hello there my dear friends of old", "en", "a", 3, "x", "x", "x", "x", "x"),
    (2, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", "x", "x", "x", "x"),
    (None, "hello there my dear friends of old", "en", "b", 3, "x", "x", "x", "x", "x"),
    (4, " \n\n\t ", "de", None, 3, "x", "x", "x", "x", "x"),
    (5, "word " * 40_000, "en", "b", 3, "x", "x", "x", "x", "x"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(odd, none):
    out = linededup.dedup_lines(odd, bits=1 << 16)
    assert out.count() == len(ODD) and set(out.columns) == set(odd.columns) | {"n_dropped"}
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()}
    # rows that share an id are one document, a row without an id is none
    assert (1, 1, 0, ODD[0][1]) in got and (None, 1, 0, ODD[0][1]) in got and (2, 1, 0, None) in got and (4, 3, 0, ODD[5][1]) in got
    assert linededup.dedup_lines(none).count() == 0


def test_minhash(odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert got == {1: (3, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (1, 5, True)}
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_one(odd).count() == len(ODD)


def test_mixing(odd, none):
    out = mixing.mix(odd)
    assert set(out.columns) == set(odd.columns) | {"rate", "shuffle_key"}
    # a null source is a source: three of them weigh the same
    rates = {r.source: r.rate for r in mixing.repetition_rates(odd).collect()}
    assert rates == {"a": 7 / 3 / 3, "b": 7 / 3 / 2, None: 7 / 3 / 2}
    assert mixing.mix(none).count() == 0 and mixing.mix(odd, {}).count() == 0
    same = {(r.doc_id, r.copy) for r in out.where("doc_id = 1").collect()}
    assert out.where("doc_id = 1").count() == 2 * len(same)


def test_packing(odd, none):
    out = packing.pack(odd, buckets=3, budget=100)
    rows = out.collect()
    assert len(rows) == len(ODD) and len({(r.batch_id, r.slot) for r in rows}) == len(ODD)
    assert all(r.padding >= 0 and r.bucket_len - r.n_tokens == r.padding for r in rows)
    assert packing.pack(none).count() == 0


def test_language(odd, none):
    model = langid.train(odd)
    out = langid.identify(odd, model)
    assert out.count() == len(ODD) and out.columns.count("lang_pred") == 1
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[5][0] == "en"
    assert langid.train(none) is None and langid.identify(none, None).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_pseudonyms(odd, none):
    out = pii.pseudonymise(odd)
    assert [r.text for r in out.orderBy("doc_id", "n_chars").collect()] == [r.text for r in odd.orderBy("doc_id", "n_chars").collect()]
    assert {r.pii_counts.__class__ for r in out.collect()} == {dict}
    assert pii.pseudonymise(none).count() == 0


def test_media(odd, none):
    out = jpeg.media_features(jpeg.store_texts(odd).withColumn("width", F.lit("x")))
    assert out.count() == len(ODD) and out.where("error is not null").count() == 0
    assert jpeg.media_features(jpeg.store_texts(none)).count() == 0


PAGES = "page_id long, url string, html string, host string, rule string, other int"


def test_urls_and_archives(spark, tmp_path):
    rows = [(1, None, None, "x", "y", 1), (2, "http://a.net/x", "p" * 2000, "x", "y", 1), (2, "http://a.net/x", "p" * 2000, "x", "y", 1), (3, "http://a.net/x", "p" * 2000, None, None, None), (None, "bad", "p" * 2000, "x", "y", 1)]
    df = spark.createDataFrame(rows, PAGES)
    out = urlfilter.judge(df)
    assert out.count() == 5 and out.columns.count("host") == 1 and {r.verdict for r in out.collect()} == {"allow", "block"}
    assert urlfilter.judge(df.where("false")).count() == 0
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    got = sorted((str(r.page_id), r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_archives(spark.read.parquet(path)).collect())
    assert got == [("1", "response", 0, None), ("2", "revisit", 2000, 3), ("2", "revisit", 2000, 3), ("3", "response", 2000, None), ("None", "response", 2000, None)]
    warc.write_archives(df.where("false"), str(tmp_path / "e"))
    assert warc.read_archives(spark.read.schema("archive_id string, content binary").parquet(str(tmp_path / "e"))).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 1, "x"), (1, [1.0, 0.0, 0.0, 0.0], 1, "x"), (2, [1.0, 0.0, 0.0, 0.0], 1, "x"), (3, [1.0, 0.0, 0.0, 0.0], 2, "x"), (4, None, 1, "x"), (5, [0.0] * 4, 1, "x"), (6, [nan, 1.0, 0.0, 0.0], 1, "x"), (7, [None, 1.0, 0.0, 0.0], 1, "x"), (8, [1.0, 0.0, 0.0, 0.0], None, "x"), (9, [1.0, 0.01], 1, "x"), (10, [2.0, 0.001, 0.0, -0.0], 1, None), (None, [1.0, 0.0, 0.0, 0.0], 1, "x"), (11, [], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 11)) and None not in got
    assert embdedup.near_duplicates(df.where("false")).count() == 0

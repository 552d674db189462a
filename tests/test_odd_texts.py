"""Queries over documents that are empty, blank, or without a letter, against their SQL."""

import duckdb
import pandas as pd
import pytest
from conftest import same

from winnower import registry
from winnower.operators.compress import compress, rated
from winnower.operators.summarize import segments

ROWS = [(1, "", "en"), (2, " \n\n ", "en"), (3, "123 456", "de"), (4, None, "en"), (5, "The cat and the dog.\n\nThe dog ran.", "en"), (6, "...", "it")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(*r, "web", len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["lang_scores", "relevance_rank", "relevance_focus", "compress_statistical", "compress_semantic", "compress_syntactic"])
def test_texts_without_words(name, spark, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    same(registry.QUERIES[name](spark, odd).toPandas(), con.execute(registry.ORACLES[name]).df())


def test_topics_of_equal_depth():
    """Depths that are equal are no more than their mean less half of no deviation, whatever a rounded sum says."""
    sizes = [("alpha alpha alpha. beta. alpha. " * 9).split(". ")[:n] for n in range(7, 27)] + [("alpha omega alpha. delta. alpha gamma. beta. delta. delta omega. " * 5).split(". ")[:n] for n in range(7, 29)]
    frame = pd.DataFrame([(i, ". ".join(s) + ".", "en") for i, s in enumerate(sizes)], columns=["doc_id", "text", "lang"])
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(registry.ORACLES["topic_segments"]).df()
    got = {(i, a, b, t) for i, text in zip(frame["doc_id"], frame["text"], strict=True) for a, b, t in segments(text)}
    assert got == set(zip(want["doc_id"], want["start"], want["end"], want["text"], strict=True))


def test_statistical_compression_shuffles_nothing(spark):
    texts = spark.createDataFrame([(1, "The cat saw Rome. It ran.", "eng")], "id long, text string, iso3 string")
    out = compress(texts, "statistical", lang="iso3")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_marks_of_rated_words():
    # the best word of a sentence below the threshold stays; a text without scored words keeps its words
    # (scores by hand: 4 sentences, each word in one; a and d 2 (ln 2 + 1), b half of that: the median is theirs)
    assert rated("SSSESSEZE", ["a", "a", "b", ".", "d", "d", ".", "the", "."]) == "ll..ll.l."
    assert rated("KDPU", ["x", "1", ",", "y"]) == "W..W"


@pytest.mark.parametrize("name", ["summary_chat", "summary_tfidf", "summary_topic"])
def test_summaries_get_small_batches(name, spark, odd):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        registry.QUERIES[name](spark, odd)
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, old)

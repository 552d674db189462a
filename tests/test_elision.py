"""Leading clauses go where a supplied table tells verbs; without one nothing is elided."""

import pytest

from winnower.functions.lexicon import DEFAULT, Lexicon, default_table
from winnower.operators.compress import compress


def shorten(spark, texts, verbs=("beg", "check", "send", "bought", "ate", "want"), lang="eng"):
    rows = [*DEFAULT.rows(), *((lang, "pos", v, "VERB") for v in verbs), (lang, "pos", "cake", "NOUN")]
    table = spark.createDataFrame(rows, "iso3 string, kind string, key string, value string")
    lexicon = Lexicon.from_table(table)
    df = spark.createDataFrame([(k, t, lang) for k, t in enumerate(texts)], "k int, text string, iso3 string")
    return [r.compressed_text for r in compress(df, "syntactic", lang="iso3", lexicon=lexicon).orderBy("k").collect()]


def test_a_hedge_before_the_last_verb_goes(spark):
    hedge, plain = shorten(spark, ["I kindly beg you to check the invoice.", "Check the invoice."])
    assert hedge.lower() == plain.lower() == "check the invoice"


def test_coordinated_clauses_stay(spark):
    (out,) = shorten(spark, ["I bought bread and ate cake."])
    assert "bread" in out and "bought" in out and "ate" in out and "cake" in out


def test_one_verb_or_other_sentences_are_left_alone(spark):
    out = shorten(spark, ["Please send the report. I want to check the numbers now.", "The report was late!"])
    assert out[0].startswith("Please send the report") or out[0].lower().startswith("send the report")
    assert "want" not in out[0] and "check the numbers" in out[0]
    assert "report" in out[1]


def test_names_are_never_elided(spark):
    (out,) = shorten(spark, ["I beg Marta to check the invoice."])
    assert "Marta" in out and "beg" not in out.split() and out.endswith("check the invoice")


@pytest.mark.parametrize("text", ["I kindly beg you to check the invoice.", ""])
def test_without_tags_nothing_is_elided(spark, text):
    df = spark.createDataFrame([(text, "eng")], "text string, iso3 string")
    plain = compress(df, "syntactic", lang="iso3").first().compressed_text
    assert ("beg" in plain) == ("beg" in text)
    assert Lexicon.from_table(default_table(spark)).pos == {}

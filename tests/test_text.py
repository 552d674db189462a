"""Tokens, languages, compression: cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from winnower.functions import tokens as T
from winnower.functions.lexicon import DEFAULT, Lexicon, derived_generic, lemma_map
from winnower.operators import agents, compress, langid

EN = "I would like to know if it is possible to receive information about restaurants in Rome, please."


def one(spark, text, level, lang="eng", lexicon=DEFAULT):
    df = spark.createDataFrame([(text, lang)], "text string, iso3 string")
    return compress.compress(df, level, lang="iso3", lexicon=lexicon).first()


def test_levels_on_a_sentence(spark):
    light = one(spark, EN, "light")
    assert light.original_tokens == 19
    assert light.compressed_text == "like know possible receive information about restaurants Rome"
    assert one(spark, EN, "semantic").compressed_text == light.compressed_text
    assert one(spark, EN, "aggressive").compressed_text == "like information about restaurants Rome"


def test_lemmas_come_from_the_lexicon(spark):
    lex = Lexicon(lemma={"eng": {"restaurants": "restaurant"}}, pos={"eng": {"restaurants": "NOUN"}})
    assert "restaurant" in one(spark, EN, "semantic", lexicon=lex).compressed_text.split()
    assert "restaurant" not in one(spark, EN, "aggressive", lexicon=lex).compressed_text.split()
    adverb = Lexicon(lemma={"ita": {"subito": "subire"}}, pos={"ita": {"subito": "ADV"}})
    assert one(spark, "arriva subito", "semantic", "ita", adverb).compressed_text == "arriva subito"


@pytest.mark.parametrize("text", ["", "   ", "...!?", None, "the of and", "Go."])
@pytest.mark.parametrize("level", compress.LEVELS)
def test_never_an_error_and_never_longer(spark, text, level):
    for lang in ("eng", "xxx"):
        r = one(spark, text, level, lang)
        assert r.compressed_tokens <= r.original_tokens


def test_one_word_survives_the_hard_levels(spark):
    for level in ("aggressive", "syntactic"):
        assert one(spark, "Go.", level).compressed_text == "go"


@pytest.mark.parametrize(("text", "lang", "word"), [("non è vero", "ita", "non"), ("this is not true", "eng", "not"), ("ce n'est pas vrai", "fra", "pas"), ("das ist nicht wahr", "deu", "nicht"), ("no es verdad", "spa", "no")])
def test_negation_is_kept(spark, text, lang, word):
    for level in ("light", "semantic", "aggressive", "statistical", "syntactic"):
        assert word in one(spark, text, level, lang).compressed_text.split()


def test_german_capitals_are_no_names(spark):
    assert one(spark, "das schöne Haus", "semantic", "deu").compressed_text == "schöne haus"
    assert one(spark, "we saw London", "semantic", "eng").compressed_text == "saw London"


@pytest.mark.parametrize(("text", "lang"), [("questo è il libro della mia amica", "ita"), ("este es el libro de mi hermano y los otros", "spa"), ("les enfants sont dans la maison avec nous", "fra"), ("he walked and talked", "eng"), ("", "eng"), ("12345 !!", "eng"), (None, "eng")])
def test_language(spark, text, lang):
    assert langid.detect(spark.createDataFrame([(text,)], "text string")).first().detected == lang


def test_counters(spark):
    r = spark.createDataFrame([("a bb hello informatics",)], "text string").select(T.pieces_count("text").alias("p"), T.words_count("text").alias("w"), T.chars_count("text").alias("c")).first()
    assert (r.p, r.w, r.c) == (7, 4, 5)


def test_typed_split_covers_the_text(spark):
    text = "See https://x.org/a, mail a.b@c.de 12,5% — o'clock\n😀\x00"
    parts = spark.createDataFrame([(text,)], "text string").select(T.typed_tokens("text").alias("t")).first().t
    assert "".join(p.text for p in parts) == text
    kinds = {p.text: p.type for p in parts}
    assert kinds["https://x.org/a,"] == "URL" and kinds["a.b@c.de"] == "Email" and kinds["12,5"] == "Number" and kinds["o'clock"] == "Word" and kinds["\n"] == "Newline" and kinds["—"] == "Punctuation"


def test_han_segments():
    words = frozenset(["大学", "大学生", "学生", "我们"])
    assert agents.segment_han("我们大学生", words) == ["我们", "大学生"]
    assert agents.segment_han("不好", words) == ["不", "好"]


def test_custom_filter(spark):
    df = spark.createDataFrame([("the 3 cats, Anna", "eng")], "text string, iso3 string")
    # a lone comma counts as a number
    assert compress.custom_filter(df, keep_only=["NUM", "PROPN"]).first().compressed_text == "3 , Anna"
    assert compress.custom_filter(df, remove=["PUNCT", "FUNC"]).first().compressed_text == "3 cats Anna"
    assert compress.custom_filter(df, predicate=lambda w: F.length(w) > 3).first().compressed_text == "cats Anna"


def test_lexicon_helpers():
    assert lemma_map({"go": ["went", "goes"]}, {"Went": "wend"}) == {"went": "wend", "goes": "go"}
    verbs = {f"v{i}": [f"v{i}{j}" for j in range(4 + i)] for i in range(12)}
    assert derived_generic(verbs)[0] == "v11"

"""Usual texts and tokens are told by cheap tests first, with the results of the full ones."""

from pyspark.sql import functions as F

from winnower.operators import agents, compress, content, langid


def frame(spark, rows):
    return spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k long, text string")


def test_types_of_odd_lines(spark):
    rows = {" at x\n at y": "LogOrStackTrace", "\n\nat x\n\nat y": "LogOrStackTrace", "a\rb\r\tat x\r\tat y": "LogOrStackTrace", "look at x\nlook at y": "PlainText", "a  iNfo\nWarning": "LogOrStackTrace", "information\nwarned": "PlainText", " [1]\n": "JsonArray", "　[1]\x85": "PlainText", " \x85 ": "PlainText", "v 1.5\n 12. x": "SearchResults", "a b:3:b": "SearchResults", "a <DIV>": "Html", "a--- b": "PlainText"}
    got = frame(spark, rows).select("text", content.content_type().alias("t")).collect()
    assert {r.text: r.t for r in got} == rows


def test_types_need_no_pass_that_copies_the_text(spark):
    plan = frame(spark, ["a"]).select(content.content_type().alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_noise_is_looked_for_where_there_is_some(spark):
    rows = {"50 % of [x] it": False, "plain": False, "café —": False, "\x1b[1m": True, "a\rb": True, "⠙": True, "███": True, "▏▏▏": False, "▏▏▏ 4%": True, "[==>] 4%": True}
    got = frame(spark, rows).select("text", content.noisy().alias("n"), content.strip_noise().alias("c")).collect()
    assert {r.text: r.n for r in got} == rows
    assert all(r.n or r.c == r.text or "▏" in r.text for r in got)


def test_tokens_by_their_first_letter(spark):
    text = "The cat NOT nOt tHe Haus, Der Ⅷ \u0001the. Not beautiful École 12! Kein Hund. _x"
    d = frame(spark, [text])
    shown = lambda level, lang: compress.compress(d.withColumn("l", F.lit(lang)), level, lang="l").first().compressed_text
    assert shown("semantic", "eng") == "cat NOT nOt Haus Der Not beautiful École kein Hund"
    assert shown("semantic", "deu") == "the cat not not the haus the not beautiful école Kein hund"
    plan = compress.compress(d.withColumn("l", F.lit("eng")), "semantic", lang="l").select("compressed_text")._jdf.queryExecution().analyzed().toString()
    assert "translate(" not in plan


def test_hits_are_counted_once_for_each_list(spark):
    df = langid.with_hits(frame(spark, ["the der und il the"]))
    r = df.first()
    assert r["_n"] == 5 and sum(r["_raw"]) >= 5 and all(m <= n for m, n in zip(r["_marks"], r["_raw"], strict=True))
    plan = df.select("_raw", "_marks")._jdf.queryExecution().analyzed().toString()
    assert "_own_hits" in plan


def test_budget_takes_the_quick_routing(spark):
    """what is over the budget is summarised, the rest is routed as it was."""
    rows = ["the cat and the dog. " * 60, "short", None, "50 % of it"]
    got = agents.fit_budget(frame(spark, rows), 20).orderBy("k").collect()
    assert [r.fits for r in got] == [r.tokens <= 20 for r in got] and got[1].fitted == "short" and got[2].tokens == 0

"""What keeps a task small: batches, and texts that are scored where they are."""

from winnower.functions import tokens as K
from winnower.operators import structured, summarize


def test_routing_takes_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    structured.route(spark.createDataFrame([(1, "a text")], "k long, text string"))
    assert int(spark.conf.get(key)) <= 1000


def test_lines_are_scored_without_windows(spark, data):
    plan = summarize.sentence_tfidf(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_usual_tokens_are_told_first(spark):
    df = spark.createDataFrame([("a b\t1,5 x@y.org www.a.b wwwx !\n",)], "text string").select(K.typed_tokens("text").alias("t"))
    got = [(x.text, x.type) for x in df.first().t if x.text != " "]
    assert got == [("a", "Word"), ("b", "Word"), ("\t", "Whitespace"), ("1,5", "Number"), ("x@y.org", "Email"), ("www.a.b", "URL"), ("wwwx", "Word"), ("!", "Punctuation"), ("\n", "Newline")]
    spark.conf.set("spark.sql.maxToStringFields", "1000")
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.index("THEN Word") < plan.index("THEN URL")

"""The pass over prose of Latin letters gives what the expressions give, and leaves other texts to them."""

from pyspark.sql import functions as F

from winnower.operators import compress, prose, structured

ODD = [
    "The cat NOT nOt tHe Haus, Der \u0001the. Not beautiful École 12! Kein Hund. _x ._y'z Next", "Ne pas … élégant. don't n'a'b x²y ½ 1,5 a’b the-cat", "niet de het een huis. Het Huis", "carefully. is wonderful I a O",
    "il perché non né. Né Non", "the of and. to", "..a..B", "", " \n", "Ⅷ The cat", "Die кошка the", "the İstanbul The", "á The. The", "not _NOT Not'Not", "No. nO no",
]


def test_pass_gives_what_expressions_give(spark):
    taken = [c for c in map(chr, range(0x2100)) if not prose.OTHER.search(c)]
    assert len(taken) == 0x250 - 1 + 24 + 47 + 1
    texts = ODD + [f"a {c}b. {c} {c}c{c} The{c} {c}The x{c}'{c}y not{c} the" for c in taken]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    for level in ("light", "semantic", "aggressive"):
        wanted = {r.k: r.compressed_text for r in compress.compress(df, level).select("k", "compressed_text").collect()}
        got = {r.k: r.t for r in df.select("k", prose.squeezed("text", F.lit(level)).alias("t")).collect()}
        left = {texts[k] for k, t in got.items() if t is None}
        assert left == {x for x in ODD if prose.OTHER.search(x)} and len(left) == 4
        assert {k: t for k, t in got.items() if t is not None} == {k: t for k, t in wanted.items() if got[k] is not None}


def test_routing_takes_the_pass_and_leaves_no_text_out(spark):
    """no token of Latin prose is looked at by an expression; other texts are routed as before."""
    texts = ["The cat and the dog were seen by all. " * 5, "Кошка и the собака were seen. " * 5, "Ⅷ the The of. " * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    r = structured.route(df, "text", "agent")
    assert "_quick" in r._jdf.queryExecution().analyzed().toString()
    wanted = [x.compressed_text for x in compress.compress(df, "semantic").orderBy("k").collect()]
    assert [x.routed for x in r.orderBy("k").collect()] == wanted and prose.squeeze(texts[0], "semantic") == wanted[0]

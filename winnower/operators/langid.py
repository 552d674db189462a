"""Language identification by function words: hits per language, exclusive markers first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions import tokens as T
from winnower.functions.lexicon import DEFAULT, ISO1, Lexicon
from winnower.sources import tables

LEAST_RATIO = 0.02


def _among(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda w: w.isin(words)) if words else F.slice(tokens, 1, 0)


def _hits(tokens: Column, words: list[str]) -> Column:
    return F.size(_among(tokens, words)) if words else F.lit(0)


def with_hits(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``df`` with the number of tokens, and for each language its hits and marker hits.

    The texts are tokenised once and reduced to the tokens that are in any list.
    """
    known = sorted({w for words in (*lexicon.function.values(), *lexicon.exclusive.values()) for w in words})
    langs = lexicon.languages
    base = df.withColumn("_all", T.detector_tokens(text)).withColumn("_n", F.size("_all")).withColumn("_t", F.filter("_all", lambda w: w.isin(known)))
    # the tokens of each language; markers that its list doesn't hold are looked up among all
    own = base.withColumn("_own_hits", F.array(*(_among(F.col("_t"), lexicon.function[k]) for k in langs)))
    raw = F.transform("_own_hits", lambda own: F.size(own))
    among = [F.col("_own_hits")[i] if set(lexicon.exclusive.get(k, ())) <= set(lexicon.function[k]) else F.col("_t") for i, k in enumerate(langs)]
    marks = F.array(*(_hits(tokens, lexicon.exclusive.get(k, [])) for k, tokens in zip(langs, among, strict=True)))
    return own.withColumn("_raw", raw).withColumn("_marks", marks).drop("_all", "_t", "_own_hits")


def detect(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT, out: str = "detected") -> DataFrame:
    """``df`` with the ISO 639-3 code of ``text``; null, blank or unknown: eng.

    A language with strictly most exclusive markers wins; else the one with most
    hits, if they are at least 2 per cent of the tokens. Ties go to the first in
    the lexicon's order.
    """
    h = with_hits(df, text, lexicon)
    langs = F.array(*(F.lit(k) for k in lexicon.languages))
    top_mark, top_raw = F.array_max("_marks"), F.array_max("_raw")
    one_mark = F.size(F.filter("_marks", lambda x: x == F.array_max("_marks"))) == 1
    second = F.coalesce(F.array_max(F.filter("_raw", lambda x: x < F.array_max("_raw"))), F.lit(0))
    tied = F.size(F.filter("_raw", lambda x: x == F.array_max("_raw"))) > 1
    first = F.element_at(langs, F.array_position("_raw", top_raw).cast("int"))
    code = (
        F.when(F.col("_raw").isNull() | (F.coalesce(top_raw, F.lit(0)) == 0), "eng")
        .when((top_mark > 0) & one_mark, F.element_at(langs, F.array_position("_marks", top_mark).cast("int")))
        .when(top_raw / F.col("_n") < LEAST_RATIO, "eng")
        # a tie, of two hits or more or fewer, goes to the first curated language
        .when(tied | (top_raw > second), first)
        .otherwise("eng")
    )
    return h.withColumn(out, code).drop("_n", "_raw", "_marks")


def scores(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``df`` with one row for each language with hits: (iso3, score).

    The score is hits per token plus half the exclusive markers per token. Texts
    without any hit have one row, eng with 1.0.
    """
    h = with_hits(df, text, lexicon)
    langs = lexicon.languages
    parts = F.array(*(F.struct(F.lit(k).alias("iso3"), F.try_divide(F.col("_raw")[i] + 0.5 * F.col("_marks")[i], F.col("_n")).alias("score"), F.col("_raw")[i].alias("raw")) for i, k in enumerate(langs)))
    some = F.filter(parts, lambda p: p["raw"] > 0)
    none = F.array(F.struct(F.lit("eng").alias("iso3"), F.lit(1.0).alias("score"), F.lit(1).alias("raw")))
    return h.withColumn("_s", F.explode(F.when(F.size(some) > 0, some).otherwise(none))).select(*df.columns, F.col("_s.iso3").alias("iso3"), F.col("_s.score").alias("score"))


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(tables.read(spark, sf_dir, "documents")).select("doc_id", "detected")


def lang_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(tables.read(spark, sf_dir, "documents")).select("doc_id", "iso3", F.round("score", 6).alias("score"))


def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect(tables.read(spark, sf_dir, "documents"))
    return d.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


def lexicon_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the lists and of what can be derived from them."""
    from winnower.functions.lexicon import ambiguous_words, default_table

    shared = spark.createDataFrame([(k, "ambiguous", w, None) for k, ws in ambiguous_words(DEFAULT.function).items() for w in ws], "iso3 string, kind string, key string, value string")
    return default_table(spark).unionByName(shared).groupBy("iso3", "kind").agg(F.count_distinct("key").alias("words"))


def values(kinds: tuple[str, ...]) -> str:
    """The lexicon as rows of an SQL VALUES list."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(i)}, {quote(k)}, {quote(w)})" for i, k, w, _ in DEFAULT.rows() if k in kinds)


_ORDER = ", ".join(f"('{k}', {i})" for i, k in enumerate(DEFAULT.languages))
_DETECT = f"""
WITH lex(iso3, kind, w) AS (VALUES {values(("function", "exclusive"))}), ord(iso3, o) AS (VALUES {_ORDER}),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.LETTERS_RE2.replace("'", "''")}')) AS w FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
hit AS (SELECT doc_id, iso3, count(*) FILTER (kind = 'function') AS raw, count(*) FILTER (kind = 'exclusive') AS mark
  FROM tok JOIN lex USING (w) GROUP BY doc_id, iso3),
best AS (SELECT doc_id, max(raw) AS top_raw, max(mark) AS top_mark, arg_min(iso3, -raw * 100 + o) AS first,
  arg_min(iso3, -mark * 100 + o) AS marked FROM hit JOIN ord USING (iso3) GROUP BY doc_id),
ties AS (SELECT doc_id, count(*) FILTER (mark = top_mark) AS mark_ties FROM hit JOIN best USING (doc_id) GROUP BY doc_id),
verdict AS (SELECT d.doc_id, d.lang, CASE WHEN coalesce(top_raw, 0) = 0 THEN 'eng' WHEN top_mark > 0 AND mark_ties = 1 THEN marked
  WHEN top_raw / n.n::DOUBLE < {LEAST_RATIO} THEN 'eng' ELSE first END AS detected
  FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN ties USING (doc_id) LEFT JOIN n USING (doc_id))
"""

QUERIES = {"lang_detect": lang_detect, "lang_scores": lang_scores, "lang_confusion": lang_confusion, "lexicon_sets": lexicon_sets}
ORACLES = {
    "lang_detect": _DETECT + "SELECT doc_id, detected FROM verdict",
    "lang_confusion": _DETECT + "SELECT lang, detected, count(*) AS n FROM verdict GROUP BY lang, detected",
    "lang_scores": _DETECT + """SELECT d.doc_id, coalesce(h.iso3, 'eng') AS iso3, round(coalesce((h.raw + 0.5::DOUBLE * h.mark) / n.n, 1.0), 6) AS score
        FROM documents d LEFT JOIN (SELECT * FROM hit WHERE raw > 0) h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "lexicon_sets": f"""WITH lex(iso3, kind, w) AS (VALUES {values(("function", "generic", "exclusive", "negation"))})
        SELECT iso3, kind, count(DISTINCT w) AS words FROM lex GROUP BY iso3, kind UNION ALL
        SELECT a.iso3, 'ambiguous', count(DISTINCT a.w) FROM lex a JOIN lex b ON a.w = b.w AND a.iso3 <> b.iso3 AND a.kind = 'function' AND b.kind = 'function' GROUP BY a.iso3""",
}

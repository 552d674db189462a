"""A corpus pipeline: language, lines, near-duplicates, mixture, batches.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``docs``, whatever their names: columns named
like those that an operator adds are kept out of its way and come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import common, langid, linededup, minhash, mixing, packing

#: A document with letters goes only if its language's calibrated probability is not
#: even so many times that of a draw among all languages.
MIN_LIFT = 1.25


def _apart(docs: DataFrame, added: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)`` with the columns of ``docs``, those named as in ``added`` untouched."""
    clash = [c for c in docs.columns if c.lower() in added]
    away = dict(zip(clash, common.free(docs, *(f"own_{k}" for k in range(len(clash)))), strict=True))
    out = work(docs.select(*(F.col(common.quoted(c)).alias(away.get(c, c)) for c in docs.columns)))
    return out.select(*(F.col(common.quoted(away.get(c, c))).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that can be told; others go.

    A null or empty text, or one without a letter, has none; nor has one whose
    score, times the number of languages, is below MIN_LIFT: for the model it might be
    in any. Without any labelled row there is no model, and then all documents with a
    letter stay. Repeated rows and very long texts are
    judged like others, an empty table stays empty.
    """
    model = langid.train(docs.where(~langid.held_out())) if {"lang", "doc_id"} <= set(docs.columns) else None
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return _apart(docs, ("lang_pred", "score"), lambda d: langid.identify(d, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") * len(model.languages) >= min(MIN_LIFT, len(model.languages)))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line stays in its first document only.

    n_chars, where there is such a column, is counted anew for texts that lost a line.
    Null and empty texts and rows without an id stay as they are, repeated rows keep
    the same lines, very long texts are taken whole, an empty table stays empty.
    """

    def work(d: DataFrame) -> DataFrame:
        out = linededup.dedup_lines(d)
        if "n_chars" not in d.columns:
            return out
        count = F.length("text").cast(d.schema["n_chars"].dataType)
        return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, count).otherwise(F.col("n_chars")))

    return _apart(docs, ("n_lines", "n_dropped"), work)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Texts that are null, empty or without words, and rows without an id, are nobody's
    duplicates; rows that share a kept id all stay. Very long texts are compared
    whole, an empty table stays empty.
    """
    return minhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to equal weights, in a global shuffle.

    A null source is a source; without such a column all rows are of one. Rows that
    share an id have as many copies; null, empty and very long texts are texts. An
    empty table stays empty.
    """

    def work(d: DataFrame) -> DataFrame:
        if "source" in d.columns:
            return mixing.mix(d)
        (name,) = common.free(d, "source_of_all")
        return mixing.mix(d.withColumn(name, F.lit(None).cast("string")), source=name)

    return _apart(docs, ("copy", "rate", "shuffle_key"), work)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each copy, with its id and, if there is one, its source.

    A null or empty text has no tokens and is all padding, a very long one has a batch
    of its own; repeated rows have a slot each; an empty table gives no batch.
    """
    known = [c for c in ("doc_id", "source") if c in docs.columns]
    out = packing.pack(docs.select(*known, packing.word_count().alias("n_words")), tokens=F.col("n_words"))
    return out.select(*known, "n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("batches", batches),
]

#: Hashing, a trained model and dynamic programming cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"pipeline-{name}")
    return docs

"""Token counts, costs and splitters over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions import tokens as T
from winnower.sources import tables


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.compression_tokens("text")).cast("long").alias("n_tokens"), T.chars_count("text").alias("n_quarters"), T.words_count("text").alias("n_words"), T.pieces_count("text").alias("n_pieces"))


def token_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").withColumn("p", T.pieces_count("text"))
    return d.select("doc_id", *(T.model_count(F.col("p"), m).alias(m.replace("-", "_").replace(".", "_")) for m in T.MODEL_FACTORS))


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").withColumn("p", T.pieces_count("text"))
    usd = T.cost_usd(F.col("p"), "gpt-4")
    return d.select("doc_id", F.round(usd, 6).alias("usd"), F.round(usd * T.USD_TO_EUR, 6).alias("eur"), F.round(T.energy_mwh(F.col("p")), 6).alias("energy_mwh"), F.round(T.energy_mwh(F.col("p")) * T.CO2_MG, 6).alias("co2_mg"))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select(F.explode(T.retrieval_tokens("text")).alias("term"))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def bag_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").withColumn("b", T.bag_tokens("text"))
    return d.select("doc_id", F.size("b").cast("long").alias("n"), F.size(F.array_distinct("b")).cast("long").alias("n_distinct"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").withColumn("b", T.blocks("text"))
    return d.select("doc_id", F.size("b").cast("long").alias("n_blocks"), F.size(T.chat_blocks("text")).cast("long").alias("n_chat_blocks"))


def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", T.strip_markdown("text").alias("plain"))


def typed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.explode(T.typed_tokens("text")).alias("t"))
    return d.groupBy("doc_id", F.col("t.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t.text")).alias("chars"))


_SHORT = ", ".join(f"'{w}'" for w in T.SHORT_PIECES)
_PIECES = f"""CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN 0 ELSE greatest(1, (
  coalesce(list_sum(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]+|[^\\s\\v\\x{{85}}\\p{{Z}}]'), lambda w:
    CASE WHEN lower(w) IN ({_SHORT}) OR length(w) <= 4 THEN 1 WHEN length(w) <= 8 THEN 2 ELSE 2 + (length(w) - 5) // 4 END)), 0)
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\s\\v\\x{{85}}\\p{{Z}}]{{4,}}'), lambda w: length(w) // 4)), 0))) END::BIGINT"""

QUERIES = {
    "token_counts": token_counts,
    "token_models": token_models,
    "token_cost": token_cost,
    "term_frequencies": term_frequencies,
    "bag_sizes": bag_sizes,
    "text_blocks": text_blocks,
    "markdown_strip": markdown_strip,
    "typed_split": typed_split,
}

ORACLES = {
    "token_counts": f"""SELECT doc_id, len(regexp_extract_all(text, '{T.WORD_OR_SIGN_RE2.replace("'", "''")}'))::BIGINT AS n_tokens,
        (length(text) // 4)::BIGINT AS n_quarters,
        len(list_filter(regexp_split_to_array(text, '[\\s\\v\\x{{85}}\\p{{Z}}]+'), lambda w: w <> ''))::BIGINT AS n_words, {_PIECES} AS n_pieces FROM documents""",
    "token_models": "SELECT doc_id, " + ", ".join(f"trunc(p * {f}::DOUBLE)::BIGINT AS {m.replace('-', '_').replace('.', '_')}" for m, f in T.MODEL_FACTORS.items()) + f" FROM (SELECT doc_id, {_PIECES} AS p FROM documents)",
    "token_cost": f"""SELECT doc_id, round(p / 1000.0::DOUBLE * 0.03::DOUBLE, 6) AS usd, round(p / 1000.0::DOUBLE * 0.03::DOUBLE * 0.92::DOUBLE, 6) AS eur,
        round(p * 0.005::DOUBLE, 6) AS energy_mwh, round(p * 0.005::DOUBLE * 0.4::DOUBLE, 6) AS co2_mg FROM (SELECT doc_id, {_PIECES} AS p FROM documents)""",
    "term_frequencies": "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) AS term FROM documents) GROUP BY term",
    "bag_sizes": """SELECT doc_id, len(b)::BIGINT AS n, len(list_distinct(b))::BIGINT AS n_distinct FROM (
        SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: length(w) >= 3) AS b FROM documents)""",
    "text_blocks": """SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda b: trim(b) <> ''))::BIGINT AS n_blocks,
        len(list_filter(regexp_split_to_array(text, '\\n{2,}'), lambda b: trim(b) <> ''))::BIGINT AS n_chat_blocks FROM documents""",
    "markdown_strip": f"SELECT conv_id, turn, regexp_replace(text, '{T.MARKDOWN}', '', 'g') AS plain FROM conversations",
}

"""Mixing sources to target weights by Poisson replication.

A source that has n of N rows and the target weight w is to be repeated w N / n
times on average. Each row's count is the inverse of that Poisson distribution at
a uniform number hashed from the seed and the row's id: reproducible, independent
of partitioning, and without any coordination between tasks. A rate above MAX_RATE
is split into equal parts, whose counts are drawn apart and added up (a sum of
Poisson numbers is one): so distribution functions stay short, and the copies of a
row of a very rare source are made by many tasks. Copies are dealt out by a hash of
(seed, id, copy) to all partitions and sorted by it there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import common

SEED = "mix-1"
#: Rates above this are drawn in parts.
MAX_RATE = 64.0
#: Each part numbers its copies from its own multiple of this; no part draws so many.
PART_COPIES = 256


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from ``parts``: 52 bits of their MD5."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: str) -> Column:
    """The distribution function at 0, 1, ..., far enough that it is 1 in double precision."""
    return F.expr(
        f"""aggregate(
          sequence(1, cast(ceil({rate} + 12 * sqrt({rate}) + 24) as int)),
          named_struct('p', -{rate}, 'cdf', array(exp(-{rate}))),
          (s, k) -> named_struct(
            'p', s.p + ln({rate}) - ln(cast(k as double)),
            'cdf', array_append(s.cdf, element_at(s.cdf, -1) + exp(s.p + ln({rate}) - ln(cast(k as double))))),
          s -> s.cdf)"""
    )


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source") -> DataFrame:
    """Rows (source, rate): the mean number of copies of a row of each source.

    Weights are shares of rows after mixing, in any unit. Without weights all
    sources weigh the same; with them, a source not named weighs nothing. A null
    source is a source of its own, named by the key ``""`` if by any.
    """
    sizes = docs.groupBy(F.col(common.quoted(source)).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = F.lit(1.0)
    elif weights:
        pairs = F.create_map([F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        w = F.coalesce(pairs[F.coalesce("source", F.lit(""))], F.lit(0.0))
    else:
        w = F.lit(0.0)
    sizes = common.materialise(sizes.withColumn("w", w), "sources")
    total = sizes.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    if not total.n or not total.w:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    return sizes.select("source", (F.lit(float(total.n)) * F.col("w") / F.lit(float(total.w)) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED, source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mixed rows: ``docs``' columns, copy, rate and shuffle_key.

    ``copy`` numbers a row's copies 1, 2, ...; where the rate is above MAX_RATE, each
    part of it numbers its own from the next multiple of PART_COPIES. Rows that draw no
    copy go; that is the sampling asked for. Rows that share an id have the same draw;
    rows without an id draw by a hash of their columns. A null source is a source, a
    null, empty or very long text a text. Same-named columns are replaced, others pass
    through, whatever their names. An empty table gives an empty result.
    """
    rates = repetition_rates(docs, weights, source)
    name, rate, parts, cdf, key, part, n, copy = common.free(docs, "name", "mean", "parts", "cdf", "key", "part", "n", "nth")
    split = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("int")
    steps = rates.where("rate > 0").select(F.col("source").alias(name), F.col("rate").alias(rate), split.alias(parts), (F.col("rate") / split).alias("each"))
    steps, most = common.counted(steps.select(name, rate, parts, poisson_cdf("each").alias(cdf)), "rates", F.max(parts).alias("parts"))
    rest = common.columns(docs, ("copy", "rate", "shuffle_key"))
    the_id = F.col(common.quoted(id_col)).cast("string")
    the_id = F.when(the_id.isNull(), F.concat(F.lit("null:"), common.content_hash(docs).cast("string"))).otherwise(the_id)
    own = docs.select("*", the_id.alias(key))
    # one small row for each source; Spark broadcasts it only if its size allows
    drawn = own.join(steps, F.col(common.quoted(source)).cast("string").eqNullSafe(F.col(name)))

    def copies(rows: DataFrame, u: Column, first: Column) -> tuple[DataFrame, Column]:
        rows = rows.withColumn(n, F.size(F.filter(cdf, lambda c: c <= u))).where(F.col(n) > 0)
        return rows, F.explode(F.sequence(first + 1, first + F.col(n))).alias(copy)

    rows, each = copies(drawn.where(F.col(parts) == 1), uniform(F.lit(seed), F.col(key)), F.lit(0))
    out = rows.select(*rest, each, F.col(rate), F.col(key))
    if (most.parts or 1) > 1:
        many = drawn.where(F.col(parts) > 1).withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
        # parts of one row go to many tasks before their copies are made
        many = many.repartition(key, part)
        rows, each = copies(many, uniform(F.lit(seed), F.col(key), F.col(part)), F.col(part) * PART_COPIES)
        out = out.unionAll(rows.select(*rest, each, F.col(rate), F.col(key)))
    final = out.select(*rest, F.col(copy).alias("copy"), F.col(rate).alias("rate"), F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col(key), F.col(copy))).alias("shuffle_key"))
    return final.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` mixed so that all sources weigh the same."""
    out = mix(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "copy", F.round("rate", 9).alias("rate"), "shuffle_key", "text")


ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, (SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE / n AS rate FROM sizes
), cdf AS (
  SELECT source, rate, 0 AS k, -rate AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p + ln(rate) - ln((k + 1)::DOUBLE), c + exp(p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 24)
), drawn AS (
  SELECT doc_id, source, text, (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT)::DOUBLE / {1 << 52}.0 AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, d.text, c.rate, count(*) AS n
  FROM drawn d JOIN cdf c ON d.source = c.source AND c.c <= d.u
  GROUP BY d.doc_id, d.source, d.text, c.rate
)
SELECT doc_id, source, copy::INTEGER AS copy, round(rate, 9) AS rate,
       md5('{SEED}:order:' || doc_id || ':' || copy) AS shuffle_key, text
FROM (SELECT *, unnest(generate_series(1, n)) AS copy FROM counted)
"""

"""Packing: optimal length buckets and token-budget batches.

The global histogram of lengths goes to the driver, where dynamic programming
chooses the boundaries of at most ``buckets`` buckets that minimise padding, in
whole numbers. It has one entry for each length that occurs: lengths that differ
add up to no more than all tokens, so there are at most sqrt(2 x tokens) of them.
Inside each bucket rows are dealt into shards of bounded size by a hash of what
they hold, and each shard cuts batches of as many rows as the token budget allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnower.llm import common

BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_ROWS = 32_768


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(common.quoted(text)).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def histogram(lengths: DataFrame, n: str = "n_tokens") -> list[tuple[int, int]]:
    """(length, rows) of each length that occurs, ascending."""
    table = lengths.groupBy(F.col(n).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy("n").toArrow()
    return list(zip(table["n"].to_pylist(), table["rows"].to_pylist(), strict=True))


def boundaries(hist: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """The bucket lengths, ascending, that minimise the sum of padding.

    Padding of a bucket is its longest length times its rows, less its tokens; the
    tokens are the same for all cuts, so the first part is minimised. With fewer
    lengths than buckets, each length is a bucket. For one more bucket, the best cut
    before a length t is the lowest of the lines best[i] - t rows[i]; their slopes fall
    and t rises, so a queue of lines from the hull gives each cut in turn.
    """
    if not hist:
        return []
    n, cuts = len(hist), []
    below = [0]
    for _, rows in hist:
        below.append(below[-1] + rows)
    best = [top * below[j + 1] for j, (top, _) in enumerate(hist)]
    for _ in range(min(buckets, n) - 1):
        # line i: the cut behind the first i lengths, at the height best[i - 1]
        lines, first, new, cut = [], 0, [], []
        for j, (top, _) in enumerate(hist):
            height, slope = (best[j - 1] if j else 0), below[j]
            while len(lines) - first >= 2:
                (_, h1, s1), (_, h2, s2) = lines[-2], lines[-1]
                if (height - h1) * (s2 - s1) > (h2 - h1) * (slope - s1):
                    break
                lines.pop()
            lines.append((j, height, slope))
            while first + 1 < len(lines) and lines[first + 1][1] - top * lines[first + 1][2] < lines[first][1] - top * lines[first][2]:
                first += 1
            i, h, s = lines[first]
            cut.append(i)
            new.append(h - top * s + top * below[j + 1])
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        out.append(hist[j - 1][0])
        j = cut[j - 1]
        if not j:
            break
    if j:
        out.append(hist[j - 1][0])
    return out[::-1]


def _spread(sized: DataFrame, own: str, share: int) -> DataFrame:
    """Rows that are equal in all columns, beyond ``share`` of them, get hashes of their own.

    Such rows are numbered in two steps, inside each file of the written table and
    across files, and each ``share`` of the numbers goes its own way: the result
    depends on their number alone.
    """
    hot = common.materialise(sized.groupBy(own).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select(own), "hot")
    if hot.isEmpty():
        return sized
    file, before, nth = common.free(sized, "file", "before", "nth")
    placed = sized.withColumn(file, F.col("_metadata.file_path"))
    sums = placed.join(hot, own, "left_semi").groupBy(own, file).agg(F.count(F.lit(1)).alias("n"))
    # a window over the files of one hash, not over its rows
    sums = common.materialise(sums.select(own, file, (F.sum("n").over(Window.partitionBy(own).orderBy(file)) - F.col("n")).alias(before)), "before")
    rows = placed.join(sums, [own, file]).withColumn(nth, F.row_number().over(Window.partitionBy(own, file).orderBy(F.lit(1))) - 1 + F.col(before))
    rows = rows.withColumn(own, F.xxhash64(own, F.expr(f"`{nth}` div {share}")))
    return sized.join(hot, own, "left_anti").select(sized.columns).unionAll(rows.select(sized.columns))


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", tokens: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with n_tokens, bucket, bucket_len, batch_id, slot and padding.

    Every row comes back, repeated rows each with their own slot; where rows lie makes
    no difference. A null or empty text has length 0 and is packed as padding only, a
    null in ``tokens`` counts as 0. A batch holds at most ``budget`` tokens with
    padding, or one row that is longer by itself. Same-named columns are replaced,
    others pass through, whatever their names. Ids may be null or repeated. An empty
    table gives an empty result. The rows are written once, with their lengths, to the
    shared folder: pass only the columns that are needed.
    """
    new = ("n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding")
    own, size = common.free(docs, "own", "size")
    count = word_count(text) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    rest = common.columns(docs, new)
    renamed = [f"c{k}" for k in range(len(rest))]
    # names of their own on disk: those of the user may be any
    written = docs.withColumn(size, count).withColumn(own, common.content_hash(docs)).select(*(c.alias(r) for c, r in zip(rest, renamed, strict=True)), F.col(size).alias("size"), F.col(own).alias("own"))
    sized = common.materialise(written, "sized")
    hist = histogram(sized, "size")
    names = [c for c in docs.columns if c.lower() not in new]
    back = [F.col(r).alias(c) for r, c in zip(renamed, names, strict=True)]
    tops = boundaries(hist, buckets)
    zero = F.lit(0).cast("long")
    if not tops:
        return sized.select(*back, F.col("size").alias("n_tokens"), F.lit(0).alias("bucket"), zero.alias("bucket_len"), F.lit("").alias("batch_id"), zero.alias("slot"), zero.alias("padding"))
    in_bucket, k = [0] * len(tops), 0
    for top, rows in hist:
        while top > tops[k]:
            k += 1
        in_bucket[k] += rows
    shards = F.array(*(F.lit(-(-n // shard_rows) or 1).cast("long") for n in in_bucket))
    lens = F.array(*(F.lit(t).cast("long") for t in tops))
    dealt = _spread(sized, "own", max(1, shard_rows // 4)).withColumn("at", F.size(F.filter(lens, lambda t: t < F.col("size"))))
    dealt = dealt.withColumn("length", F.greatest(F.lit(1).cast("long"), lens[F.col("at")])).withColumn("shard", F.pmod("own", shards[F.col("at")]))
    turn = F.row_number().over(Window.partitionBy("at", "shard").orderBy("own", "size")) - 1
    dealt = dealt.withColumn("nth", turn.cast("long")).withColumn("per", F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div length")))
    return dealt.select(
        *back, F.col("size").alias("n_tokens"), F.col("at").alias("bucket"), F.col("length").alias("bucket_len"),
        F.concat_ws("-", F.col("at"), F.col("shard"), F.expr("nth div per")).alias("batch_id"),
        F.pmod("nth", "per").alias("slot"), (F.col("length") - F.col("size")).alias("padding"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", word_count().alias("n_words"))
    return pack(docs, tokens=F.col("n_words")).select("doc_id", "n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding")

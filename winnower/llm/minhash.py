"""MinHash near-duplicates: one-permutation hashing, optimal densification, star edges.

One hash of each five-word shingle fills all bins of a document's sketch (one
permutation); empty bins borrow the value of a bin drawn by a hash of (bin,
attempt), the same draw for all documents (optimal densification). Bins are
grouped into bands; documents with equal bands share a bucket.

What happens in a bucket is bounded. Documents with the same set of shingles are
first folded into a class; of the classes in a bucket, each is joined to two
centres only (a star around the smallest id and one around a hash-drawn member).
All edges are confirmed on full sets. A bucket whose members are not one
component after that is worked on again, only across components: a small one by
pairs at once, large ones by a star around the member closest to what most of them
share, and then by an exact filter on their differences from that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import common, shingles as S

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
SHINGLE = 5
SIMILARITY = 0.8
#: Buckets of at most this many classes are finished at once, all classes of one
#: component against those of the others; larger ones by the exact filter.
SMALL_BUCKET = 32
#: A set with more edges than this is copied, so that so many of them meet one copy.
HUB_EDGES = 256
#: So many members, about, tell what a group has in common; the result does not depend on it.
SAMPLED = 64
#: Parts of the bands, worked on in turns.
PARTS = 4
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
_ROW = np.random.default_rng(7).integers(1, 1 << 63, BINS, dtype=np.uint64) | np.uint64(1)


def _donors(tries: int = 64) -> np.ndarray:
    grid = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(tries, dtype=np.uint64)[None, :]
    return (S.mix(grid + np.uint64(0x0D15EA5E)) % np.uint64(BINS)).astype(np.int64)


_DONORS = _donors()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a sorted array of distinct hashes."""
    at = np.searchsorted(hashes, _EDGES)
    to = np.append(at[1:], len(hashes))
    filled = at < to
    out = np.where(filled, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
    empty = np.flatnonzero(~filled)
    attempt = 0
    while len(empty):
        if attempt == _DONORS.shape[1]:  # hardly any bin is filled: take the next one up
            full = np.flatnonzero(filled)
            out[empty] = out[full[np.searchsorted(full, empty) % len(full)]]
            break
        donor = _DONORS[empty, attempt]
        good = filled[donor]
        out[empty[good]] = out[donor[good]]
        empty = empty[~good]
        attempt += 1
    return out


def band_keys(sketched: np.ndarray) -> np.ndarray:
    mixed = (sketched * _ROW).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return S.mix(mixed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def _batches(col: pa.Array, n: int):
    data, offsets = S.text_bytes(col)
    hashes, first = S.words(data, offsets)
    for k in range(len(offsets) - 1):
        yield S.shingles(hashes[first[k] : first[k + 1]], n)


def sketches(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, n_shingles, set_key, bands) of each row of ``docs``.

    A null or empty text, or one without words, has no shingles and null bands.
    """
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>"

    def run(batches):
        for b in batches:
            keys, bands, counts = [], [], []
            for s in _batches(b.column(1), n):
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(sketch(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"), F.col(common.quoted(text)).cast("string").alias("text")).mapInArrow(run, schema)


def _set_column(n: int):
    """The full shingle set as a column, so that the partitioning of a join stays."""

    @F.pandas_udf("array<long>")
    def full_set(texts: pd.Series) -> pd.Series:
        return pd.Series([s.view(np.int64) for s in _batches(pa.array(texts, pa.string(), from_pandas=True), n)])

    return full_set


def _confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``edges(a, b)``, a written table, whose full sets reach the similarity.

    A set of very many edges is copied under several keys, among which its edges are
    dealt out, so that they don't meet in one task.
    """
    ends = edges.select(F.col("a").alias("doc_id")).unionAll(edges.select("b"))
    hubs = ends.groupBy("doc_id").agg(F.expr(f"cast(ceil(count(1) / {HUB_EDGES}) as int)").alias("copies")).where("copies > 1")
    hubs = common.materialise(hubs, "hubs")
    copied = sets.join(hubs, "doc_id", "left").select("doc_id", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), "shingles")
    a = copied.select(F.col("doc_id").alias("a"), F.col("copy").alias("ca"), F.col("shingles").alias("sa"))
    b = copied.select(F.col("doc_id").alias("b"), F.col("copy").alias("cb"), F.col("shingles").alias("sb"))
    for end, other in ("ab", "ba"):
        many = hubs.select(F.col("doc_id").alias(end), F.col("copies").alias(f"n{end}"))
        edges = edges.join(many, end, "left").withColumn(f"c{end}", F.coalesce(F.pmod(F.xxhash64(other), f"n{end}"), F.lit(0)).cast("int"))
    both = edges.join(a, ["a", "ca"]).join(b, ["b", "cb"])
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b")


def _long_enough(a: str, b: str, percent: int):
    """Sets whose sizes alone rule the similarity out need no comparison."""
    return F.least(F.col(a), F.col(b)) * 100 >= F.greatest(F.col(a), F.col(b)) * percent


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", id_col: str = "doc_id", n: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of each distinct id of ``docs``.

    Documents are linked if the Jaccard similarity of their sets of distinct
    ``n``-word shingles is at least ``similarity`` (compared in whole per cent).
    ``component_id`` is the smallest id reachable by links. Documents without
    words are linked with nothing. Rows with a null id are left out. Rows that
    share an id count as one document, that with the longest (then greatest) text.
    Extra columns are ignored; an empty table gives an empty result.
    """
    percent = round(similarity * 100)
    docs = _one_row_an_id(docs.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"), F.col(common.quoted(text)).cast("string").alias("text")))
    seen = common.materialise(sketches(docs, n=n), "sketches")

    classes = seen.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = common.materialise(classes, "classes")
    buckets = classes.select(F.col("rep").alias("member"), "size", F.posexplode("bands").alias("band", "bucket"))
    centres = buckets.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct("member", "size")).alias("low"),
        F.min(F.struct(F.xxhash64("member", "bucket").alias("h"), "member", "size")).alias("drawn"),
    ).where("members > 1")
    # a table of its own: the join below is then one of plain scans, whose skewed partitions Spark splits
    centres = common.materialise(centres, "centres")
    shared = common.materialise(buckets.join(centres, "bucket"), "shared")

    star = shared.select("member", "size", F.explode(F.array(F.struct("low.member", "low.size"), F.struct("drawn.member", "drawn.size"))).alias("c"))
    star = star.where(F.col("c.member") != F.col("member"))
    wanted = common.materialise(_pairs(star.select("member", "size", F.col("c.member").alias("other"), F.col("c.size").alias("other_size")), percent), "edges")

    ends = shared.select(F.col("member").alias("doc_id")).distinct()
    texts = docs.join(ends, "doc_id", "left_semi").select("doc_id", _set_column(n)("text").alias("shingles"))
    sets = common.materialise(texts, "sets")

    links = common.materialise(_confirm(wanted, sets, percent), "links")
    component = common.connected_components(links)
    component = _complete(shared, component, wanted, links, sets, percent)
    common.discard(sets)
    common.discard(shared)

    rep = seen.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key")
    whole = rep.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = seen.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of (member, size, other, other_size)."""
    rows = rows.where(_long_enough("size", "other_size", percent))
    return rows.select(F.least("member", "other").alias("a"), F.greatest("member", "other").alias("b")).distinct()


def _complete(shared: DataFrame, component: DataFrame, tried: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components after the buckets that stars left in several components are worked on.

    Only buckets of more than two members can hold links that no star has tried.
    Large buckets come first, by a star of their own; then small ones in turns, a part
    of the bands each, so that what one part links is known to the next; then what is
    still open of the large ones.
    """

    def try_(pairs: DataFrame) -> None:
        nonlocal tried, links, component
        more, new = common.counted(pairs.join(tried, ["a", "b"], "left_anti"), "edges")
        if new.n:
            tried = tried.unionByName(more)
            found, got = common.counted(_confirm(more, sets, percent), "links")
            if got.n:
                links = links.unionByName(found)
                component = common.connected_components(links)

    rows = shared.select("bucket", "band", "member", "size", "members", F.col("low.member").alias("centre"))
    apart = None
    large = _still_open(rows.where(F.col("members") > SMALL_BUCKET), component)
    if large is not None:
        # buckets that share a class are one group, so that no class is worked on twice
        edges = large.select(F.col("member").alias("a"), F.col("centre").alias("b")).distinct()
        group = common.connected_components(edges, "groups").select(F.col("id").alias("centre"), F.col("component").alias("group"))
        large = common.materialise(large.join(group, "centre", "left").withColumn("centre", F.coalesce("group", "centre")).drop("group"), "large")
        apart = _differences(large, sets)
        try_(_star(apart, component, percent))
    for p in range(PARTS):
        few = _still_open(rows.where(f"members between 3 and {SMALL_BUCKET} and band % {PARTS} = {p}"), component)
        if few is not None:
            other = few.select("bucket", F.col("member").alias("other"), F.col("size").alias("other_size"), F.col("component").alias("other_component"))
            try_(_pairs(few.join(other, "bucket").where("member < other and component <> other_component"), percent))
    if apart is not None:
        left = _still_open(large.drop("component"), component)
        if left is not None:
            apart = apart.join(common.materialise(left.select("centre", "member").distinct(), "left"), ["centre", "member"], "left_semi")
            try_(_close_pairs(_with_component(apart, component), percent))
    return component


def _differences(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (centre, member, size, delta): members of open large buckets and their differences.

    Buckets that share a class are one group, named by its smallest. A member's set is
    replaced by its difference from a reference: what a family has in common cancels
    out, and the symmetric difference of two sets is that of their differences. Any
    reference gives the same result; taken is what more than half of some members
    have, about SAMPLED of them drawn by a hash. The elements of a difference are in
    one order for the whole group: those that a member has beyond the reference, from
    the rarest, then those that it lacks. Elements of one member alone come with 1.
    """
    group = common.materialise(rows.groupBy("centre", "member").agg(F.first("size").alias("size")), "groups")
    one = common.materialise(group.join(sets.select(F.col("doc_id").alias("member"), "shingles"), "member"), "members")
    # tables of their own: where they are small, members need not be dealt out to meet them
    sizes = common.materialise(group.groupBy("centre").agg(F.expr(f"cast(ceil(count(1) / {SAMPLED}) as int)").alias("step")), "sizes")
    few = one.join(sizes, "centre").where(F.pmod(F.xxhash64("member"), "step") == 0).select("centre", "member", "shingles")
    drawn = common.materialise(few.groupBy("centre").agg(F.count(F.lit(1)).alias("drawn")), "drawn")
    counts = few.select("centre", F.explode("shingles").alias("token")).groupBy("centre", "token").agg(F.count(F.lit(1)).alias("n"))
    most = counts.join(drawn, "centre").where("2 * n > drawn").groupBy("centre").agg(F.collect_list("token").alias("most"))
    both = one.join(common.materialise(most, "most"), "centre", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    parts = common.materialise(both.select("centre", "member", "size", F.array_except("shingles", "most").alias("more"), F.array_except("most", "shingles").alias("less")), "parts")

    tokens = parts.select("centre", "member", F.explode("more").alias("token"))
    shared = common.materialise(tokens.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    own = tokens.join(shared, ["centre", "token"], "left").groupBy("centre", "member").agg(F.collect_list(F.struct(F.coalesce("often", F.lit(1).cast("long")).alias("often"), "token")).alias("own"))
    whole = parts.join(common.materialise(own, "own"), ["centre", "member"], "left")
    last = F.transform("less", lambda t: F.struct(F.lit((1 << 63) - 1).alias("often"), t.alias("token")))
    delta = F.sort_array(F.concat(F.coalesce("own", F.array().cast("array<struct<often:bigint,token:bigint>>")), last))
    return common.materialise(whole.select("centre", "member", "size", delta.alias("delta")), "apart")


def _with_component(rows: DataFrame, component: DataFrame) -> DataFrame:
    now = component.select(F.col("id").alias("member"), "component")
    return rows.join(now, "member", "left").withColumn("component", F.coalesce("component", "member"))


def _star(apart: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs of members with the one of their group that is closest to what it shares.

    Sets of a and b elements are linked if their symmetric difference is at most
    h = (a + b) (100 - percent) / (100 + percent); it is at most the sum of their two
    differences x and y. With a member's excess e = x - a (100 - percent) / (100 + percent),
    two of them are linked for certain if their excesses add up to 0 or less, and then
    both are linked to the member of the least excess. So this star leaves no such pair
    apart.
    """
    rows = _with_component(apart.select("centre", "member", "size", (F.size("delta") * (100 + percent) - F.col("size") * (100 - percent)).alias("excess")), component)
    rows = common.materialise(rows, "excess")
    least = common.materialise(rows.groupBy("centre").agg(F.min(F.struct("excess", "member", "size", "component")).alias("z")), "least")
    near = rows.join(least, "centre").where("excess + z.excess <= 0 and component <> z.component")
    return _pairs(near.select("member", "size", F.col("z.member").alias("other"), F.col("z.size").alias("other_size")), percent)


def _close_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """All other pairs of open groups, across components, that can reach the similarity; exact.

    Two sets whose excesses (see ``_star``) add up to more than 0 are only linked if
    their differences x and y share at least max(1, (x + y - h) / 2) elements. With
    elements in order from the rarest, the first shared one is then among the first
    (x - y + h) / 2 + 1 of x and (y - x + h) / 2 + 1 of y. Members of a group's largest
    component are only met by others, never among themselves.
    """
    apart = common.materialise(apart, "apart")
    counts = apart.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("centre").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    # the largest h of a set, and so the longest start: that of the larger of two differences
    most = (F.col("size") * (100 - percent) / percent).cast("int") + 1
    starts = apart.select("centre", "member", "size", "component", F.size("delta").alias("d"), F.posexplode(F.slice("delta", F.lit(1), most)).alias("at", "e"))
    # elements of one member alone keep their places in the order, but pair nothing
    starts = starts.where("e.often > 1").select("centre", F.col("e.token").alias("token"), "member", "size", "component", "d", "at")
    # tables of their own, so that skewed partitions of the join can be split
    starts = common.materialise(starts, "starts")
    main = common.materialise(counts, "main")
    rest = common.materialise(starts.join(main, "centre").where("component <> main").drop("main"), "rest")

    x, y = rest.alias("x"), starts.alias("y")
    h = f"floor((x.size + y.size) * {100 - percent} / {100 + percent})"
    meet = F.expr(f"x.centre = y.centre and x.token = y.token and x.component <> y.component and 2 * x.at <= x.d - y.d + {h} and 2 * y.at <= y.d - x.d + {h}")
    return _pairs(x.join(y, meet).select(F.col("x.member").alias("member"), F.col("x.size").alias("size"), F.col("y.member").alias("other"), F.col("y.size").alias("other_size")), percent)


def _still_open(rows: DataFrame, component: DataFrame) -> DataFrame | None:
    """The rows of buckets of several components, with the component of each; None if there is none."""
    rows, all_ = common.counted(_with_component(rows, component), "rows")
    if not all_.n:
        return None
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    # a table of its own: the join is then one of plain scans, whose skewed partitions Spark splits
    rows, left = common.counted(rows.join(common.materialise(mixed, "mixed"), "bucket", "left_semi"), "open")
    return rows if left.n else None


def _one_row_an_id(docs: DataFrame) -> DataFrame:
    docs = docs.where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("s")).select("doc_id", "s.text")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without those near-duplicate to an earlier document.

    Rows with a null id are kept; of rows that share a kept id all are kept.
    """
    spare = near_duplicates(docs, similarity).where("not kept").select("doc_id")
    return docs.join(spare, "doc_id", "left_anti")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` at 85 per cent."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), 0.85)

"""Line deduplication with two Bloom filters.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys
of at least ``MIN_KEY`` code points that occur in two documents or more lose all
their lines except in the smallest document id that holds them.

1. Every task notes the filter bits of its lines' hashes: bits set once, bits set
   twice. Tasks' bits are merged segment by segment (twice = twice in one of them,
   or once in two), in a stream, so that one segment is held at a time.
2. The twice-seen filter, at most ``FILTER_BITS`` bits whatever the input, is
   broadcast. Only lines that it suspects are shuffled, as SHA-256 digests.
3. Suspects are confirmed exactly: their digest has two different document ids or
   more. The smallest is the first occurrence; the digests to be dropped go back
   to their documents.

If the input has so many lines that the filter fills up, more lines are suspected
and shuffled; the result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.llm import common

MIN_KEY = 10
#: The filter's proven size: 2**28 bits are 32 MiB.
FILTER_BITS = 1 << 28
#: A segment is 8 KiB, so that an Arrow batch of 1,000 of them stays small.
SEGMENT_BITS = 1 << 16
PROBES = 3
_STRIP = b" \t\n\x0b\x0c\r"
#: Hashes that a task holds before it hands its bits on.
FLUSH = 1 << 18


def filter_bits(docs: DataFrame) -> int:
    """A bit for each 8 bytes that Spark expects ``docs`` to have: one segment at least, FILTER_BITS at most.

    The size decides how many lines are suspected in vain, never the result.
    """
    expected = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(FILTER_BITS, max(SEGMENT_BITS, 1 << (expected // 8).bit_length()))


def keys_of(text: str | None, at_least: int = MIN_KEY) -> list[bytes | None]:
    """For each line of a text its key, or None where the key is too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(_STRIP)
        n = len(key)
        out.append(key if n >= 4 * at_least or (n >= at_least and len(key.decode("utf-8", "surrogatepass")) >= at_least) else None)
    return out


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash, all in one segment of the filter."""
    segment = (hashes >> np.uint64(32)) % np.uint64(max(1, bits // SEGMENT_BITS))
    size = np.uint64(min(bits, SEGMENT_BITS))
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    return np.stack([segment * size + (hashes + np.uint64(k) * step) % size for k in range(PROBES)], axis=1)


def _pack(positions: np.ndarray, size: int) -> bytes:
    """A segment's bits: a short list of positions, or the bits themselves."""
    if len(positions) * 16 < size:
        return positions.astype(np.uint16).tobytes()
    bits = np.zeros(size, dtype=bool)
    bits[positions.astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    """A segment's bits, eight to a byte."""
    if len(raw) * 8 < size:
        bits = np.zeros(size, dtype=bool)
        bits[np.frombuffer(raw, np.uint16)] = True
        return np.packbits(bits)
    return np.frombuffer(raw, np.uint8).copy()


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64)


def twice_seen(docs: DataFrame, bits: int = FILTER_BITS) -> dict[int, bytes]:
    """The segments of the filter of hashes that may occur twice; empty ones are left out.

    ``docs`` has the columns doc_id and text. What comes back has at most ``bits`` bits.
    """
    size = min(bits, SEGMENT_BITS)

    def emit(held: list[np.ndarray]):
        # the probes of one hash never count twice for one bit
        spots = np.sort(_positions(np.concatenate(held), bits), axis=1)
        fresh = np.ones(spots.shape, dtype=bool)
        fresh[:, 1:] = spots[:, 1:] != spots[:, :-1]
        once, counts = np.unique(spots[fresh], return_counts=True)
        twice = once[counts > 1]
        edges = np.unique(once // np.uint64(size))
        lo, hi = edges * np.uint64(size), (edges + np.uint64(1)) * np.uint64(size)
        cuts = [(np.searchsorted(x, lo), np.searchsorted(x, hi)) for x in (once, twice)]
        cols = [[_pack(x[i:j] - low, size) for i, j, low in zip(*cut, lo, strict=True)] for x, cut in zip((once, twice), cuts, strict=True)]
        for k in range(0, len(edges), common.BATCH_ROWS):
            part = slice(k, k + common.BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(edges[part].astype(np.int32)), *(pa.array(c[part], pa.binary()) for c in cols)], ["segment", "once", "twice"])

    def note(batches):
        held, n = [], 0
        for b in batches:
            for text in b.column(0):
                held.append(_hashes({k for k in keys_of(text.as_py()) if k is not None}))
                n += len(held[-1])
                if n >= FLUSH:
                    yield from emit(held)
                    held, n = [], 0
        if n:
            yield from emit(held)

    def merge(batches):
        # rows come segment by segment: one pair of bitmaps is held at a time
        at, seen_once, seen_twice = None, None, None

        def done():
            if at is not None and seen_twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([seen_twice.tobytes()], pa.binary())], ["segment", "twice"])

        for b in batches:
            for s, *both in zip(*b.columns, strict=True):
                s, (once, twice) = s.as_py(), (_unpack(x.as_py(), size) for x in both)
                if s != at:
                    yield from done()
                    at, seen_once, seen_twice = s, once, twice
                else:
                    seen_twice |= twice
                    seen_twice |= seen_once & once
                    seen_once |= once
        yield from done()

    noted = docs.where("doc_id is not null").select("text").mapInArrow(note, "segment int, once binary, twice binary")
    merged = noted.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    # of proven size: at most FILTER_BITS bits
    return {r.segment: bytes(r.twice) for r in merged.collect()}


def _hits(segments: dict[int, bytes], hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where the filter holds all bits of a hash, in ascending order."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    size = np.uint64(min(bits, SEGMENT_BITS))
    spots = _positions(hashes, bits)
    segment = (spots[:, 0] // size).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    cuts = np.flatnonzero(np.diff(segment[order], prepend=-1))
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        rows = order[lo:hi]
        raw = segments.get(int(segment[rows[0]]))
        if raw is not None:
            own = spots[rows] % size
            whole = np.frombuffer(raw, np.uint8)[own >> np.uint64(3)] >> (np.uint64(7) - (own & np.uint64(7))).astype(np.uint8)
            out.append(rows[(whole & 1).all(axis=1)])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _suspects(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (doc_id, key): the digests of lines that the filter suspects."""
    filter_ = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits))

    def run(batches):
        for b in batches:
            ids, keys = [], []
            for i, text in zip(*b.columns, strict=True):
                own = {k for k in keys_of(text.as_py()) if k is not None}
                keys.extend(own)
                ids.extend([i.as_py()] * len(own))
            at = _hits(filter_.value, _hashes(keys), bits)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in at], pa.int64()), pa.array([hashlib.sha256(keys[k]).digest() for k in at], pa.binary())], ["doc_id", "key"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, key binary")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_dropped", T.LongType())]))
def _without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    kept, counts = [], []
    for text, drop in zip(texts, drops, strict=True):
        if drop is None:
            kept.append(None)
            counts.append(0)
            continue
        gone = {bytes(d) for d in drop}
        lines = (text or "").split("\n")
        stay = [line for line, key in zip(lines, keys_of(text), strict=True) if key is None or hashlib.sha256(key).digest() not in gone]
        kept.append("\n".join(stay))
        counts.append(len(lines) - len(stay))
    return pd.DataFrame({"text": kept, "n_dropped": counts})


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int | None = None) -> DataFrame:
    """``docs`` with repeated lines dropped, and the columns n_lines and n_dropped.

    n_lines counts the lines before dropping; a null or empty text is one empty
    line and stays as it is. A text that loses all its lines becomes empty; texts
    of any length are taken whole. Rows with a null id stay as they are and are no
    occurrence. Rows that share an id are one document: they all keep the line of
    which it is the first. An empty table gives an empty result. Columns named
    n_lines or n_dropped are replaced; all others pass through, whatever their names.
    """
    common.small_batches(docs.sparkSession)
    the_id, the_text = F.col(common.quoted(id_col)), F.col(common.quoted(text))
    plain = docs.select(the_id.cast("long").alias("doc_id"), the_text.cast("string").alias("text"))
    bits = filter_bits(plain) if bits is None else bits
    suspects = common.materialise(_suspects(plain, bits), "suspects")
    first = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # a table of its own: the join is then one of plain scans, whose skewed partitions Spark splits
    first = common.materialise(first.select("key", "first"), "first")
    drops = suspects.join(first, "key").where("doc_id <> first")
    by, gone, done = common.free(docs, "drop_id", "drops", "done")
    drops = drops.groupBy(F.col("doc_id").alias(by)).agg(F.collect_set("key").alias(gone))
    both = docs.join(drops, the_id == F.col(by), "left")
    # texts that lose nothing don't travel to Python
    both = both.withColumn(done, _without(F.when(F.col(gone).isNotNull(), the_text.cast("string")), F.col(gone)))
    whole = F.coalesce(the_text.cast("string"), F.lit(""))
    return both.select(
        *((F.coalesce(F.col(done)["text"], the_text).alias(c) if c == text else F.col(common.quoted(c))) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")),
        (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.col(done)["n_dropped"], F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without repeated lines, by digest."""
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (f.k IS NOT NULL AND l.doc_id <> f.first) AS gone
  FROM lines l LEFT JOIN firsts f ON l.k = f.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

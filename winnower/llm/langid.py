"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text, in which every run of
characters that are not letters is one blank; they are weighted by TF-IDF. The
model is trained with follow-the-regularised-leader (per-coordinate rates, L1 and
L2 penalties: many weights are exactly zero) on a bounded sample of labelled rows,
and its temperature is fitted on a part of that sample which the training left
out. Document frequencies come from all labelled rows, predictions from whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.llm import common

FEATURES = 1 << 15
#: The documented bounds of the training sample: so many rows of each language, and
#: so many in all, which many languages share out equally.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 800, 16_000
EPOCHS = 3
UNKNOWN = "und"
_BLANK = np.uint64(32)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MARK = "\U0010ffff"
#: Characters worked on at once; longer texts are counted piece by piece.
PIECE = 1 << 20


_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters[codes]


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hashed n-grams, one row for each order, at the place where they end."""
    c = codes.astype(np.uint64)
    one = c * _K[0]
    out = np.empty((3, len(c)), dtype=np.int32)
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    out[0] = one >> shift
    two = one.copy()
    two[1:] += c[:-1] * _K[1]
    out[1] = (two * _K[2]) >> shift
    two[2:] += c[:-2] * _K[2] ^ _K[0]
    out[2] = (two * _K[1]) >> shift
    return out


def _count_text(text: str) -> tuple[np.ndarray, bool]:
    total, any_letter = np.zeros(FEATURES), False
    for at in range(0, max(1, len(text)), PIECE):
        for counts, letters in _count_texts([text[at : at + PIECE]]):
            total += counts
            any_letter |= letters
    return total, any_letter


def _count_texts(texts: list[str]):
    """Feature counts of each text, and whether it has a letter."""
    joined = _MARK.join(t.replace(_MARK, " ") for t in texts) + _MARK
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(codes)
    mark = codes == 0x10FFFF
    # of a run of other characters only the first stays, as a blank
    keep = letter | mark
    keep[1:] |= letter[:-1]
    keep[:1] = True
    codes, letter, mark = codes[keep], letter[keep], mark[keep]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    grams = _grams(codes)
    lo = 0
    seen = np.concatenate([[0], np.cumsum(letter)])
    for hi in np.flatnonzero(mark):
        counts = np.bincount(grams[0, lo:hi], minlength=FEATURES)
        counts += np.bincount(grams[1, lo + 1 : hi], minlength=FEATURES)
        counts += np.bincount(grams[2, lo + 2 : hi], minlength=FEATURES)
        yield counts, bool(seen[hi] - seen[lo])
        lo = hi + 1


def counts_of(texts: list[str | None]):
    """(feature counts, has a letter) of each text, in order; null counts as empty."""
    group: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if len(t) > PIECE:
            yield from _count_texts(group) if group else ()
            group, size = [], 0
            yield _count_text(t)
            continue
        group.append(t)
        size += len(t)
        if size > PIECE:
            yield from _count_texts(group)
            group, size = [], 0
    if group:
        yield from _count_texts(group)


@dataclass
class Model:
    """Sparse weights, biases, idf and the calibration's temperature.

    ``weights`` has a row for each feature with a weight that is not zero, and
    ``row_of`` the row of each feature; features without one share an empty row.
    """

    languages: list[str]
    weights: np.ndarray
    row_of: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        norm = np.sqrt(x @ x)
        return at, (x / norm if norm else x)

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        at, x = self.vector(counts)
        z = (x @ self.weights[self.row_of[at]] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def fit(languages: list[str], rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal on (language, feature ids, counts); each fifth row calibrates."""
    n_classes = len(languages)
    number = {x: k for k, x in enumerate(languages)}
    z, n = np.zeros((FEATURES + 1, n_classes)), np.zeros((FEATURES + 1, n_classes))
    data = []
    for lang, at, counts in rows:
        x = np.log1p(counts) * idf[at]
        norm = np.sqrt(x @ x)
        data.append((number[lang], np.append(at, FEATURES), np.append(x / norm if norm else x, 1.0)))
    train, held = [d for k, d in enumerate(data) if k % 5], data[::5]
    train = train or held

    def weights(at):
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2)
        w[np.abs(za) <= l1] = 0
        return w

    for _ in range(epochs):
        for y, at, x in train:
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            g2 = g * g
            sigma = (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g2
    full = weights(np.arange(FEATURES + 1))
    scores = np.array([x @ full[at] for _, at, x in held])
    truth = np.array([y for y, _, _ in held])
    some = np.flatnonzero(full[:-1].any(axis=1))
    row_of = np.zeros(FEATURES, np.int32)
    row_of[some] = np.arange(1, len(some) + 1)
    return Model(languages, np.vstack([np.zeros((1, n_classes)), full[some]]), row_of, full[-1], idf, _temperature(scores, truth))


def _temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm.

    Targets are smoothed by one pseudo-row for each language, so that rows without
    any error don't call for boundless confidence.
    """
    smooth = scores.shape[1] / (len(scores) + scores.shape[1])

    def loss(t):
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        return float(-((1 - smooth) * s[np.arange(len(s)), truth] + smooth * s.mean(axis=1)).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """For each feature the number of rows of ``docs`` that have it, and the number of rows.

    Each task sums up its rows; the sums, of fixed size, meet in two steps.
    """

    def tell(total, rows):
        return pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "df"])

    def count(batches):
        total, rows = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for counts, _ in counts_of(b.column(0).to_pylist()):
                total += counts > 0
                rows += 1
        if rows:
            yield tell(total, rows)

    def add(batches):
        total, rows = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for n, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += np.frombuffer(df, np.int64)
                rows += n
        if rows:
            yield tell(total, rows)

    parts = docs.select(F.col(text).cast("string")).mapInArrow(count, "n long, df binary").repartition(16).mapInArrow(add, "n long, df binary")
    total, rows = np.zeros(FEATURES, np.int64), 0
    for r in parts.toLocalIterator():
        total += np.frombuffer(bytes(r.df), np.int64)
        rows += r.n
    return total, rows


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the rows of ``labelled``; None if no row has a language and a text.

    It learns from at most ``per_language`` rows of each language and ``sample_rows``
    in all, drawn by a hash of their ids and texts: rows that share an id are drawn
    each by its own text, equal rows together. Null languages and texts are left out,
    empty texts have no features, very long ones are counted whole.
    """
    common.small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(common.quoted(text)).cast("string").alias("text"), F.col(common.quoted(lang)).cast("string").alias("lang"), F.xxhash64(F.col(common.quoted(id_col))).alias("draw")).where("lang is not null and text is not null")
    sizes, seen = common.counted(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if not seen.n:
        return None
    each = max(1, min(per_language, sample_rows // seen.n))
    # about 1.5 times the bound by a threshold on the hash, then exactly the bound
    share = F.lit(1.5 * each) / F.col("n") + F.lit(64.0) / F.col("n")
    drawn = rows.join(sizes, "lang").where(F.col("draw") / F.lit(2.0**64) + 0.5 < share).withColumn("tie", F.xxhash64("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "tie", "text"))
    drawn = drawn.withColumn("nth", nth).where(F.col("nth") <= each).orderBy("draw", "lang", "tie", "nth").limit(sample_rows)

    def compact(batches):
        for b in batches:
            feats = [(at := np.flatnonzero(c), c[at]) for c, _ in counts_of(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([a.astype(np.uint16).tobytes() for a, _ in feats], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in feats], pa.binary())], ["lang", "draw", "tie", "nth", "at", "counts"])

    found = common.materialise(drawn.select("text", "lang", "draw", "tie", "nth").mapInArrow(compact, "lang string, draw long, tie long, nth int, at binary, counts binary"), "sample")
    sample = [(r.lang, np.frombuffer(r["at"], np.uint16), np.frombuffer(r.counts, np.float32)) for r in found.orderBy("draw", "lang", "tie", "nth").toLocalIterator()]
    df, n = document_frequencies(rows)
    return fit(sorted({x[0] for x in sample}), sample, np.log((1 + n) / (1 + df)) + 1)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id leaves 1 by 3 (null: kept)."""
    return F.coalesce(F.crc32(F.col(common.quoted(id_col)).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred and score (same-named columns are replaced).

    A null text, one without a letter, or a missing model give ``und`` and 0.0. Very
    long texts are read whole; equal texts give equal results, languages of equal
    scores the first in the alphabet. Other columns pass through, whatever their
    names; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source, back = common.plainly(docs, ("lang_pred", "score"), F.col(common.quoted(text)).cast("string"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = sent.value
        for b in batches:
            langs, scores = [], []
            for counts, letters in counts_of(b.column(b.num_columns - 1).to_pylist()):
                lang, score = m.predict(counts) if m is not None and letters else (UNKNOWN, 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    common.small_batches(docs.sparkSession)
    return source.mapInArrow(run, schema).select(*back, "lang_pred", "score")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of them is held out from training."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")

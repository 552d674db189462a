"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves; each half has its own codebook, and the two
together make a grid of cells. Every vector is stored in one cell. As a query it
visits cells in the order of the multi-sequence traversal: by the sum of two
squared lower bounds, one for each half, of the distance to the cell (the distance
to the hyperplane between two centres bounds that to the cell behind it). The
traversal ends at a bound fitted on a sample of known links for the target
recall; it never needs to pass the bound sqrt(2 - 2 cosine), beyond which no cell
can hold a link, and goes up to it where the sample has few links. What it finds is
verified by cosine in double precision.

Equal vectors are folded into one class first. A cell is compared in tiles of
bounded size (blocks of stored vectors times blocks of visitors), whatever its size.
A tile hands on one count and one root for each of its vectors, never its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import common

#: The documented bound of the sample that codebooks and the traversal's end are fitted on.
SAMPLE = 8192
TARGET_RECALL = 0.999
#: Sampled links without which the traversal goes up to the exact bound.
FEW_LINKS = 100
CELL_ROWS = 32
MAX_CENTRES = 512
TILE = 1024


@dataclass
class Index:
    """Codebooks of both halves and the bound at which traversals end."""

    centres: tuple[np.ndarray, np.ndarray]
    reach: float

    def bounds(self, half: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre, and lower bounds of the distance to each centre's cell."""
        c = self.centres[half]
        d2 = np.maximum(0, (y**2).sum(1)[:, None] - 2 * y @ c.T + (c**2).sum(1)[None, :])
        home = d2.argmin(1)
        apart = np.sqrt(np.maximum(0, ((c[:, None, :] - c[None, :, :]) ** 2).sum(-1)))
        np.fill_diagonal(apart, 1.0)
        rows = np.arange(len(y))
        low = (d2 - d2[rows, home][:, None]) / (2 * np.maximum(apart[home], 1e-12))
        low[rows, home] = 0
        return home, np.maximum(0, low)

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each vector, and the cells it visits, nearest first."""
        cut, k = unit.shape[1] // 2, len(self.centres[1])
        home_a, low_a = self.bounds(0, unit[:, :cut])
        home_b, low_b = self.bounds(1, unit[:, cut:])
        end = self.reach**2
        out = []
        for a, b in zip(low_a, low_b, strict=True):
            near_a, near_b = np.flatnonzero(a <= self.reach), np.flatnonzero(b <= self.reach)
            total = a[near_a][:, None] ** 2 + b[near_b][None, :] ** 2
            at = np.argwhere(total <= end)
            order = np.argsort(total[at[:, 0], at[:, 1]], kind="stable")
            out.append((near_a[at[:, 0]] * k + near_b[at[:, 1]])[order])
        return home_a * k + home_b, out


def _codebook(y: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(y, axis=0)
    rng = np.random.default_rng(11)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = ((c**2).sum(1)[None, :] - 2 * y @ c.T).argmin(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = y[own == j].mean(0)
    return np.unique(c, axis=0)


def fit(sample: np.ndarray, groups: np.ndarray, rows: int, n_groups: int, cosine: float, recall: float = TARGET_RECALL) -> Index:
    """An index for ``rows`` unit vectors in ``n_groups`` groups, from a sample of them."""
    cut = sample.shape[1] // 2
    k = int(np.clip(np.ceil(np.sqrt(rows / max(1, n_groups) / CELL_ROWS)), 4, MAX_CENTRES))
    # a margin for rounding: no cell within the exact bound is left out
    exact = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    index = Index((_codebook(sample[:, :cut], k), _codebook(sample[:, cut:], k)), exact)
    home_a, low_a = index.bounds(0, sample[:, :cut])
    home_b, low_b = index.bounds(1, sample[:, cut:])
    needed = []
    for at in range(0, len(sample), 512):
        block = np.arange(at, min(at + 512, len(sample)))
        near = (sample[block] @ sample.T >= cosine) & (groups[block][:, None] == groups[None, :])
        i, j = np.nonzero(near)
        i = block[i]
        i, j = i[i != j], j[i != j]
        needed.append(np.sqrt(low_a[i, home_a[j]] ** 2 + low_b[i, home_b[j]] ** 2))
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    if len(needed) >= FEW_LINKS:
        # half as far again as the target recall takes, but at least a quarter of the exact bound
        index.reach = float(min(exact, max(exact / 4, 1.5 * needed[int(np.ceil(recall * len(needed))) - 1])))
    return index


def _unit(vectors: np.ndarray) -> np.ndarray:
    # by the largest component first, so that squares neither overflow nor vanish
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _vectors(col) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in col])


def _tile(ids, mult, vec, stored, cosine):
    """(id, links, root) of a tile: counts for its visitors, roots for all with a link."""
    if stored.all() or not stored.any():
        return None
    u = _unit(vec)
    q, b = np.flatnonzero(~stored), np.flatnonzero(stored)
    near = u[q] @ u[b].T >= cosine
    near &= ids[q][:, None] != ids[b][None, :]
    links = near @ mult[b]
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(rows):
        return None
    core = near[np.ix_(rows, cols)]
    top = np.iinfo(np.int64).max
    of_q, of_b = ids[q[rows]].copy(), ids[b[cols]].copy()
    while True:  # smallest ids spread through the tile until nothing changes
        new_q = np.minimum(of_q, np.where(core, of_b[None, :], top).min(1))
        new_b = np.minimum(of_b, np.where(core, new_q[:, None], top).min(0))
        if (new_q == of_q).all() and (new_b == of_b).all():
            break
        of_q, of_b = new_q, new_b
    return (np.concatenate([ids[q[rows]], ids[b[cols]]]), np.concatenate([links[rows], np.zeros(len(cols), np.int64)]), np.concatenate([of_q, of_b]))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, vec: str = "embedding", id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of each distinct id of ``vectors``.

    Vectors are compared only with those of an equal label that is not null and the
    same number of components. Vectors that are null, empty, zero or hold a null or
    non-finite component are linked with nothing. Rows with a null id are left out;
    of rows that share an id the one with the greatest (label, vector) counts. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("vec")).where("vec_id is not null")
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.max(F.struct("label", "vec")).alias("s")).select("vec_id", "s.*")
    sound = F.expr("label is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    # minus zero is zero
    sane = rows.where(sound).select("vec_id", "label", F.expr("transform(vec, x -> x + 0.0D)").alias("vec"))
    members = common.materialise(sane.withColumn("vector_key", F.sha2(F.to_json("vec"), 256)), "vectors")
    classes = members.groupBy("label", "vector_key", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    classes = common.materialise(classes, "classes")
    links, edges = _links(spark, classes, cosine)
    component = common.connected_components(edges, "vector-components")
    own = members.select("vec_id", "label", "vector_key").join(classes.select("label", "vector_key", "rep", "mult"), ["label", "vector_key"])
    own = own.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    own = own.select("vec_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id").join(own, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(spark: SparkSession, classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Counts (vec_id, links) and edges (a, b) between the classes' representatives."""
    dims = classes.select(F.size("vec").alias("dim"), "label").groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).collect()
    indexes = {}
    for d in dims:
        drawn = classes.where(F.size("vec") == d.dim).select("rep", "label", "vec").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
        unit = _unit(np.array([r.vec for r in drawn], dtype=np.float64))
        indexes[d.dim] = fit(unit, np.array([r.label for r in drawn]), d.n, d.labels, cosine)
    sent = spark.sparkContext.broadcast(indexes)
    schema = "label string, dim int, cell int, vec_id long, mult long, stored boolean, vec binary"

    def visit(batches):
        for b in batches:
            labels, ids, mult, vecs = (b.column(k).to_pylist() for k in range(4))
            out = [[] for _ in range(7)]
            for dim in sorted({len(v) for v in vecs}):
                at = [k for k, v in enumerate(vecs) if len(v) == dim]
                x = np.array([vecs[k] for k in at], dtype=np.float64)
                home, cells = sent.value[dim].visits(_unit(x))
                for k, v, h, near in zip(at, x, home, cells, strict=True):
                    n, raw = len(near) + 1, v.tobytes()
                    for col, values in zip(out, ([labels[k]] * n, [dim] * n, [int(h), *near.tolist()], [ids[k]] * n, [mult[k]] * n, [True] + [False] * (n - 1), [raw] * n), strict=True):
                        col.extend(values)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["label", "dim", "cell", "vec_id", "mult", "stored", "vec"])

    visits = common.materialise(classes.select("label", "rep", "mult", "vec").mapInArrow(visit, schema), "visits")
    cell = ["label", "dim", "cell"]
    sizes = visits.groupBy(*cell).agg(F.count_if("stored").alias("b"), F.count_if(~F.col("stored")).alias("q")).where("b > 0 and (b > 1 or q > 1)")
    sizes = common.materialise(sizes.select(*cell, F.expr(f"cast(ceil(b / {TILE}) as int)").alias("nb"), F.expr(f"cast(ceil(q / {TILE}) as int)").alias("nq")), "cells")
    both = visits.join(sizes, cell)
    # a stored vector goes to its block of each block of visitors, and the other way round
    own = F.when(F.col("stored"), F.pmod(F.xxhash64("vec_id"), F.col("nb"))).otherwise(F.pmod(F.xxhash64("vec_id"), F.col("nq"))).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.when(F.col("stored"), F.col("nq")).otherwise(F.col("nb")) - 1))
    tiles = both.select(*cell, "vec_id", "mult", "stored", "vec", own.alias("own"), spread.alias("other"))
    tiles = tiles.select(*cell, F.when(F.col("stored"), F.col("own")).otherwise(F.col("other")).alias("block"), F.when(F.col("stored"), F.col("other")).otherwise(F.col("own")).alias("visitors"), "vec_id", "mult", "stored", "vec")
    key = [*cell, "block", "visitors"]

    def compare(batches):
        held: list[pa.Table] = []

        def done(part: pa.Table):
            ids, mult = part["vec_id"].to_numpy(), part["mult"].to_numpy()
            stored = part["stored"].combine_chunks().to_numpy(zero_copy_only=False)
            got = _tile(ids, mult, _vectors(part["vec"].combine_chunks()), stored, cosine)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64())], ["vec_id", "links", "root"])

        last = None
        for b in batches:
            t = pa.Table.from_batches([b])
            keys = list(zip(*(t[k].to_pylist() for k in key), strict=True))
            starts = [k for k in range(len(keys)) if k and keys[k] != keys[k - 1]]
            if held and keys and keys[0] != last:
                yield from done(pa.concat_tables(held))
                held = []
            for lo, hi in zip([0, *starts], [*starts, len(keys)], strict=True):
                held.append(t.slice(lo, hi - lo))
                if hi < len(keys):
                    yield from done(pa.concat_tables(held))
                    held = []
            last = keys[-1] if keys else last
        if held:
            yield from done(pa.concat_tables(held))

    found = tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "vec_id long, links long, root long")
    found = common.materialise(found, "found")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    edges = found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b"))
    common.discard(visits)
    return links, edges


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all ``embeddings`` at cosine 0.98."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"), 0.98)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.id, l.b FROM reach r JOIN link l ON r.root = l.a
), comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id
), n AS (SELECT a AS id, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN n ON n.id = v.vec_id
"""

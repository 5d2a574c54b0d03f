"""Embedding near-dedup by an epsilon grid order join.

Two vectors of one label whose cosine is at least ``t`` lie, as unit vectors, at most ``eps = sqrt(2 - 2t)`` apart, in all
and in every projection.  Vectors are projected on the leading principal directions (from the second moments of all
distinct vectors), their grid cells of width ``eps`` give the grid order, and the sorted sequence is cut into intervals
of ``INTERVAL`` vectors.  Two intervals are joined unless their boxes in the projections are more than ``eps`` apart; a join
halves both intervals again and again, skipping distant halves, down to ``LEAF`` vectors, whose cosines are computed in
double precision on the whole vectors.

Equal vectors of a label are joined once, as one class with a count.  A joined pair of intervals gives at most one row per
vector: the number of links and the smallest id it reaches within the pair, never the links themselves, so a group of
thousands of near copies costs comparisons but no rows.  Components follow from these rows.

Edge cases: a null label or id and vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are kept; vectors of different lengths don't link; repeated rows count as further vectors,
and so do rows with one id and different vectors, each with links of its own;
extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_128_digest

from .common import query, table, written
from .components import components, least_reached

COSINE = 0.98
#: Projections, vectors in an interval and in a leaf, vectors in a sorted partition.
AXES, INTERVAL, LEAF, SORTED = 8, 1024, 128, 8192
#: Largest components between which squares and their sums are far from the ends of the doubles.
LEAST, MOST = 1e-120, 1e120
#: Rows to which the tasks' second moments are added up before they are collected.
MOMENTS = 16


def fingerprinted(vectors: DataFrame, key: str, label: str, embedding: str) -> DataFrame:
    """_id, _label, fp and vec (doubles, as bytes) of every row; fp and vec are null for those that link with nothing. Narrow.

    Vectors whose squares would leave the doubles are scaled by a power of two, which changes no cosine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, out = [], []
            for k, x in enumerate(batch.column("_vec")):
                v = x.values
                fp.append(None)
                out.append(None)
                if not x.is_valid or not len(v) or v.null_count or not (batch.column("_id")[k].is_valid and batch.column("_label")[k].is_valid):
                    continue
                a = v.to_numpy(zero_copy_only=False)
                most = float(np.abs(a).max())
                if most > 0 and np.isfinite(a).all():
                    fp[-1] = xxh3_128_digest(a.tobytes())
                    if not LEAST < most < MOST:
                        a = np.ldexp(a, -math.frexp(most)[1])
                    out[-1] = a.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(fp, pa.binary()), pa.array(out, pa.binary())], ["_id", "_label", "fp", "vec"])

    some = vectors.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), F.col(embedding).cast("array<double>").alias("_vec"))
    return some.mapInArrow(run, "_id long, _label long, fp binary, vec binary")


def valid_vectors(vectors: DataFrame, key: str, label: str, embedding: str) -> DataFrame:
    """The fingerprinted rows that can link."""
    return fingerprinted(vectors, key, label, embedding).where("fp IS NOT NULL")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors, padded to ``width``."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for k, x in enumerate(rows):
        out[k, : len(x) // 8] = np.frombuffer(x)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Leading directions of the distinct unit vectors, from their summed outer products (width x width numbers a task)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            x = _matrix(batch.column("vec"), width)
            total, n = total + x.T @ x, n + len(x)
        if n:
            part = TaskContext.get().partitionId() % MOMENTS
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in group.column("m").to_pylist())
        return pa.table({"part": group.column("part")[:1], "m": pa.array([total.tobytes()], pa.binary())})

    parts = classes.select("vec").mapInArrow(moments, "part long, m binary").groupBy("part").applyInArrow(add, "part long, m binary").orderBy("part").collect()
    if not parts:
        return np.zeros((width, 0))
    values, directions = np.linalg.eigh(sum(np.frombuffer(p.m).reshape(width, width) for p in parts))
    return directions[:, np.argsort(-values)[:AXES]]


INTERVALS = "id long, label long, dim int, lo array<double>, hi array<double>, ids binary, counts binary, vecs binary, places binary"


def intervals(classes: DataFrame, axes: np.ndarray, eps: float, count: int) -> DataFrame:
    """The grid order, cut into intervals: one row each, with the box of its projections."""
    (width, k), size = axes.shape, INTERVAL

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _matrix(batch.column("vec"), width) @ axes
            cell = np.floor(place / eps).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32) * k), pa.array(cell.reshape(-1)))
            dim = pa.array([len(x) // 8 for x in batch.column("vec").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_label", "rep", "n", "vec")), dim, flat, pa.array([p.tobytes() for p in place], pa.binary())], ["label", "rep", "n", "vec", "dim", "cell", "place"])

    order = ["label", "dim", "cell", "rep"]
    ranged = classes.mapInArrow(cells, "label long, rep long, n long, vec binary, dim int, cell array<int>, place binary")
    ranged = ranged.repartitionByRange(max(1, math.ceil(count / SORTED)), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            edges = np.flatnonzero((np.diff(label) != 0) | (np.diff(dim) != 0)) + 1
            rows = []
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                for s in range(a, z, size):
                    e = min(z, s + size)
                    place = np.frombuffer(b"".join(batch.column("place")[s:e].to_pylist())).reshape(e - s, k)
                    ids, n = batch.column("rep")[s:e].to_numpy(), batch.column("n")[s:e].to_numpy()
                    rows.append({
                        "id": (part << 32) + made, "label": int(label[s]), "dim": int(dim[s]), "lo": place.min(axis=0).tolist(), "hi": place.max(axis=0).tolist(),
                        "ids": ids.tobytes(), "counts": n.tobytes(), "vecs": b"".join(batch.column("vec")[s:e].to_pylist()), "places": place.tobytes(),
                    })
                    made += 1
            kinds = {"id": pa.int64(), "label": pa.int64(), "dim": pa.int32(), "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds.get(c, pa.binary())) for c in (f.split()[0] for f in INTERVALS.split(", "))]))

    return ranged.mapInArrow(cut, INTERVALS)


def near_intervals(cut: DataFrame, eps: float) -> DataFrame:
    """Pairs (x, y), x <= y, of intervals of one label whose boxes aren't provably distant.

    They meet on the label and the cells of the first projection (an interval covers few of them, as the order begins with it).
    """
    boxes = cut.select("id", "label", "dim", "lo", "hi")
    first, last = F.floor(F.element_at("lo", 1) / eps), F.floor(F.element_at("hi", 1) / eps)
    left = boxes.withColumn("cell", F.explode(F.sequence(first - 1, last + 1)))
    right = boxes.withColumn("cell", F.explode(F.sequence(first, last))).select("label", "dim", "cell", F.col("id").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gaps = F.zip_with(F.zip_with("lo", "hi2", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with("lo2", "hi", lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda a, b: (a + b) * (a + b))
    pairs = left.join(right, ["label", "dim", "cell"]).where(F.col("id") <= F.col("y"))
    return pairs.where(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) <= eps * eps * (1 + 1e-9) + 1e-12).select(F.col("id").alias("x"), "y").distinct()


class Sequence:
    def __init__(self, ids: bytes, counts: bytes, vecs: bytes, places: bytes) -> None:
        self.ids, self.counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
        self.vecs = np.frombuffer(vecs).reshape(len(self.ids), -1)
        self.norms = np.sqrt((self.vecs * self.vecs).sum(axis=1))
        self.places = np.frombuffer(places).reshape(len(self.ids), -1)


def _join(p: Sequence, q: Sequence, a: slice, b: slice, same: bool, eps: float, cosine: float, leaf: int, out: list) -> None:
    """Append the links between two parts of sequences, halving the parts while their boxes are near."""
    x, y = p.places[a], q.places[b]
    gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
    if gap @ gap > eps * eps * (1 + 1e-9) + 1e-12:
        return
    if len(x) <= leaf and len(y) <= leaf:
        hit = (p.vecs[a] @ q.vecs[b].T) / (p.norms[a][:, None] * q.norms[b][None, :]) >= cosine
        if same and a.start == b.start:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        out.append((i + a.start, j + b.start))
        return
    for u in _halves(a, leaf):
        for v in _halves(b, leaf):
            if not same or u.start <= v.start:
                _join(p, q, u, v, same, eps, cosine, leaf, out)


def _halves(s: slice, leaf: int) -> list[slice]:
    n = s.stop - s.start
    if n <= leaf:
        return [s]
    middle = s.start + leaf * ((n + leaf - 1) // leaf // 2)
    return [slice(s.start, middle), slice(middle, s.stop)]


def links_between(pairs: DataFrame, cut: DataFrame, eps: float, cosine: float) -> DataFrame:
    """Per joined pair of intervals and vector with links there: its number of linked vectors and the smallest id reached."""
    body, leaf = ["ids", "counts", "vecs", "places"], LEAF
    both = pairs.join(cut.select(F.col("id").alias("x"), *[F.col(c).alias(f"x_{c}") for c in body]), "x")
    both = both.join(cut.select(F.col("id").alias("y"), *[F.col(c).alias(f"y_{c}") for c in body]), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("x")[row].as_py() == batch.column("y")[row].as_py()
                p = Sequence(*(batch.column(f"x_{c}")[row].as_py() for c in body))
                q = p if same else Sequence(*(batch.column(f"y_{c}")[row].as_py() for c in body))
                found: list = []
                _join(p, q, slice(0, len(p.ids)), slice(0, len(q.ids)), same, eps, cosine, leaf, found)
                i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
                if not len(i):
                    continue
                ids, counts = (p.ids, p.counts) if same else (np.concatenate([p.ids, q.ids]), np.concatenate([p.counts, q.counts]))
                j = j if same else j + len(p.ids)
                links = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
                at = np.flatnonzero(links)
                least = least_reached(ids, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(least[at])], ["rep", "links", "least"])

    return both.select("x", "y", *[f"{s}_{c}" for s in "xy" for c in body]).mapInArrow(run, "rep long, links long, least long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id (smallest id reachable) and kept."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    rows = fingerprinted(vectors, key, label, embedding)
    classes = rows.where("fp IS NOT NULL").groupBy("_label", "fp").agg(F.min("_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.min("vec").alias("vec"))
    # classes have numbers of their own, as two of them may hold the same id; the numbers are written with them
    sized = written(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    shape = sized.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vec")).alias("width")).first()
    cut = written(intervals(sized, principal_axes(sized, (shape.width or 8) // 8), eps, shape.n), "grid-order")
    pairs = written(near_intervals(cut, eps), "interval-pairs")
    found = written(links_between(pairs.repartition(max(1, pairs.count() // 16), "x", "y"), cut, eps, cosine), "links")
    comps = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "rep")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = sized.select("_label", "fp", "rep", "least_id", "n").join(totals, "rep", "left").join(comps, "rep", "left")
    classes = classes.select("_label", "fp", "least_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("of"))
    classes = written(classes, "vector-components")
    names = classes.groupBy("of").agg(F.min("least_id").alias("component"))
    linked = classes.join(names, "of").select("_label", "fp", "links", "component")
    out = rows.select(F.col("_id").alias("vec_id"), "_label", "fp").join(linked, ["_label", "fp"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS reached FROM g UNION SELECT r.node, l.y FROM r JOIN l ON r.reached = l.x),
m AS (SELECT node, min(reached) AS least FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(least, v.vec_id) AS component_id, coalesce(least, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN m ON m.node = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""


@query("op8_embeddings", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))

"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is a bag of hashed n-grams (n = 1, 2) over two readings of its blank-separated words: the lowered
word itself, and its outline (runs of capitals, other letters and digits shrunk to one sign each, "=" if the
word repeats the one before).  An n-gram weighs its share of the text's words, so the length of a text
does not count.  A score is the logistic of the sparse dot product of these shares with the weights.

Training reads a bounded sample of the labelled rows (``max_labelled``, chosen by hash); it is cut into
``SHARDS`` by hash, each shard runs the per-coordinate updates over its own rows in a fixed order, and the
weights are averaged.  Weights have a fixed size (2^``BITS``), which bounds what is collected and broadcast.

Edge cases: a null or empty text has no n-grams and gets the score of the bias alone; rows without a usable
label (null, or no row in ``labels``) are scored but not learned; if labels repeat, the lowest holds; without
any usable label every score is 0.5; repeated rows get equal scores; labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from .common import blobs, mix64, query, slices, table, two_columns

BITS = 18
SIZE = 1 << BITS
#: Rows that training reads at most (expected value of a selection by hash).
MAX_LABELLED = 24_000
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2e-4, 1e-3
ACCEPT = 0.7

OUTLINE = bytes(
    88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256)
)
RUN = re.compile(rb"(X|x|9)\1+")
#: Most outlines that a task keeps, each of at most 64 bytes: some 8 MB.
KEPT = 40_000


def _hash_outline(word: bytes) -> int:
    return xxh3_64_intdigest(RUN.sub(rb"\1", word), 7)


class Outlines(dict):
    """Hashes of outlines that a task met; long ones are rarely met again."""

    def __missing__(self, word: bytes) -> int:
        value = _hash_outline(word)
        if len(word) <= 64 and len(self) < KEPT:
            self[word] = value
        return value


_outlines = Outlines()


def forget() -> None:
    """At the end of every task, as workers live on."""
    _outlines.clear()


def features(text: bytes) -> tuple[np.ndarray, int]:
    """Indices (repeated as often as they occur) and the number of words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), 0
    own = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    shape = np.fromiter(map(_outlines.__getitem__, text.translate(OUTLINE).split()), np.uint64, n)
    same = np.zeros(n, np.uint64)
    same[1:] = own[1:] == own[:-1]
    shape = shape ^ (same * np.uint64(0x9E3779B97F4A7C15))
    two, k = np.uint64(0xD6E8FEB86659FD93), np.uint64(3)
    grams = np.concatenate([own, own[:-1] * two + own[1:], shape ^ k, shape[:-1] * two + shape[1:] ^ k])
    return (mix64(grams) >> np.uint64(64 - BITS)).astype(np.int64), n


def learn(rows: list[tuple[bytes, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the bias last) after FTRL-proximal updates over the rows in the given order."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    examples = []
    for text, label in rows:
        at, words = features(text)
        at, counts = np.unique(at, return_counts=True)
        examples.append((np.append(at, SIZE), np.append(counts / max(1, words), 1.0), label))

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in examples:
            w = weights(z[at], n[at])
            g = (_logistic(w @ x) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(z, n)


def _logistic(v):
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights learned from the labelled rows that aren't held out."""
    known = (
        labels.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~is_held_out(F.col("_id")))
        .groupBy("_id").agg(F.min("_label").alias("_label"))
        .withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / float(1 << 40))
    )
    count = known.count()
    chosen = known.where(F.col("_h") * max(count, 1) < max_labelled)
    # at most max_labelled rows of 20 bytes, by choice of the threshold
    rows = two_columns(docs, key, text).join(F.broadcast(chosen), "_id").withColumn("_shard", F.pmod(F.xxhash64("_h"), F.lit(SHARDS)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_h", "ascending"), ("_text", "ascending")])
        w = learn(list(zip(blobs(group.column("_text").combine_chunks()), group.column("_label").to_pylist(), strict=True)))
        forget()
        return pa.table({"n": pa.array([group.num_rows], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    parts = rows.groupBy("_shard").applyInArrow(run, "n long, w binary").collect()  # SHARDS rows of fixed size
    if not parts:
        return np.zeros(SIZE + 1)
    share = np.array([p.n for p in parts]) / sum(p.n for p in parts)
    return sum(s * np.frombuffer(p.w, np.float32).astype(float) for s, p in sorted(zip(share, parts, strict=True), key=lambda x: bytes(x[1].w)))


def scores(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches, "_text", 8 << 20):
            out = []
            for data in blobs(batch.column("_text")):
                at, n = features(data)
                out.append(float(_logistic(w[at].sum() / max(1, n) + w[SIZE])))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.float64())], ["doc_id", "score"])
        forget()

    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, accept: float = ACCEPT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``accept``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches, text, 8 << 20):
            good = []
            for data in blobs(batch.column(at_text)):
                at, n = features(data)
                good.append(bool(_logistic(w[at].sum() / max(1, n) + w[SIZE]) >= accept))
            yield batch.filter(pa.array(good, pa.bool_()))
        forget()

    return docs.mapInArrow(run, docs.schema)


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))

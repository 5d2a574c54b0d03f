"""Substring dedup: words covered by a window that also starts in a document with a smaller id are removed.

Three rounds over the same deal of documents into chunks (one shuffle of the texts, which all rounds reuse):

1. Count-min prefilter.  Each chunk sketches its windows, once per document: rows of counters, as wide as
   the corpus asks for (``CELLS`` per expected window), sent as sorted cell numbers by slices of the sketch.  A slice
   adds the sketches of all chunks and answers each with one bit per cell: counted at least twice or not.  Counters only
   overestimate, so every window of two documents is among those estimated repeated.
2. The chunks send only these windows (hash and smallest own id, each hash once per chunk) to buckets by hash, where the
   exact smallest id of each window is found and sent back if it is smaller than the chunk's own.
3. The chunks mark the covered words.

Nothing grows beyond a chunk, a slice or a bucket: their numbers follow the size of the corpus, and a window
that a third of all documents share comes once per chunk.  The pieces exchanged are packed, so that rows are
few: chunks x slices; raise ``CHUNK`` with the square root of the corpus.  Windows are compared by 96 bits of hash.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; rows with equal ids
don't cover each other; a null id counts as larger than all others; extra columns play no part.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from .common import blobs, mix64, query, table, two_columns

WINDOW = 13
#: Bytes of text in a chunk, windows in a bucket, counters in a slice, counters per expected window and row, rows of the sketch.
CHUNK, BUCKET, SLICE_BITS, CELLS, DEPTH = 8 << 20, 1 << 20, 23, 32, 1
LAST = np.iinfo(np.int64).max
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers as variable-length differences."""
    d = np.diff(values.astype(np.int64), prepend=0)
    size = 1 + sum((d >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = (d[some] >> (7 * k)) & 127 | np.where(size[some] > k + 1, 128, 0)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    d = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        some = starts + k <= ends
        d[some] |= (b[starts[some] + k] & 127) << (7 * k)
    return np.cumsum(d)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def grouped(h: np.ndarray, e: np.ndarray):
    """Order by (h, e) and the first place of each pair in it."""
    order = np.argsort(h, kind="stable")
    hs, es = h[order], e[order]
    if ((hs[1:] == hs[:-1]) & (es[1:] != es[:-1])).any():
        order = np.lexsort((e, h))
        hs, es = h[order], e[order]
    first = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (es[1:] != es[:-1]))) if len(h) else np.zeros(0, np.int64)
    return order, first


class Shape:
    """Numbers of chunks, slices and buckets for a corpus of so many bytes."""

    def __init__(self, size: int, window: int, depth: int) -> None:
        expected = max(1, size // 6)
        self.window, self.depth = window, depth
        self.chunks = max(1, math.ceil(size / CHUNK))
        self.slice_bits = SLICE_BITS
        self.cell_bits = max(SLICE_BITS, (CELLS * expected - 1).bit_length())
        self.bucket_bits = max(1, (expected // BUCKET).bit_length())


class Chunk:
    """The windows of some documents. Nothing here depends on the order of the rows."""

    def __init__(self, docs: pa.Table, shape: Shape) -> None:
        self.shape = shape
        w = shape.window
        self.ids = docs.column("_id").combine_chunks()
        self.words = [x.split() for x in blobs(docs.column("_text").combine_chunks())]
        n = np.array([len(x) for x in self.words], np.int64)
        total = int(n.sum())
        self.ends = np.cumsum(n)
        own = np.fromiter(map(xxh3_64_intdigest, itertools.chain.from_iterable(self.words)), np.uint64, total)
        doc = np.repeat(np.arange(len(n)), n)
        count = max(0, total - w + 1)
        self.start = np.flatnonzero(doc[:count] == doc[w - 1 : w - 1 + count])
        self.doc = doc[self.start]
        h, e = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
        for k in range(w):
            h *= M1
            h += own[k : k + count]
            e *= M2
            e += own[k : k + count]
        self.h = mix64(h[self.start])
        self.e = (mix64(e[self.start]) >> np.uint64(32)).astype(np.uint32)
        self.number = np.array([LAST if x is None else x for x in self.ids.to_pylist()], np.int64)
        self.size = total

    def cells(self, row: int) -> np.ndarray:
        return (mix64(self.h + M2 * np.uint64(row + 1)) >> np.uint64(64 - self.shape.cell_bits)).astype(np.int64)

    def sketch(self) -> list[tuple[int, bytes, bytes]]:
        """(slice, cells, whether two documents of the chunk count there)."""
        out = []
        bits_ = self.shape.slice_bits
        per_row = 1 << (self.shape.cell_bits - bits_)
        for row in range(self.shape.depth):
            cell = self.cells(row)
            order = np.argsort(cell, kind="stable")
            c, d = cell[order], self.doc[order]
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
            other = np.append(False, (c[1:] == c[:-1]) & (d[1:] != d[:-1])) if len(c) else np.zeros(0, bool)
            twice = np.add.reduceat(other, first) > 0 if len(c) else other
            c = c[first]
            part = c >> bits_
            cuts = np.searchsorted(part, np.unique(part)).tolist() + [len(c)]
            for a, b in itertools.pairwise(cuts):
                out.append((int(part[a]) + row * per_row, pack(c[a:b] & ((1 << bits_) - 1)), bits(twice[a:b])))
        return out

    def repeated(self, masks: dict[int, bytes]) -> np.ndarray:
        """Windows whose every counter stands at two or more."""
        hot = np.ones(len(self.h), bool)
        bits_ = self.shape.slice_bits
        per_row = 1 << (self.shape.cell_bits - bits_)
        for row in range(self.shape.depth):
            cell = self.cells(row)
            known = np.unique(cell)
            part = known >> bits_
            parts, cuts = np.unique(part, return_index=True)
            ends = np.append(cuts[1:], len(known))
            good = [known[a:b][flags(masks[p + row * per_row], b - a)] for p, a, b in zip(parts.tolist(), cuts.tolist(), ends.tolist(), strict=True)]
            good = np.concatenate(good) if good else known
            spot = np.minimum(np.searchsorted(good, cell), max(0, len(good) - 1))
            hot &= good[spot] == cell if len(good) else False
        return np.flatnonzero(hot)

    def asked(self, masks: dict[int, bytes]):
        """Windows estimated repeated, the group of each, and each group's hash and smallest id."""
        at = self.repeated(masks)
        h, e = self.h[at], self.e[at]
        order, first = grouped(h, e)
        least = np.minimum.reduceat(self.number[self.doc[at[order]]], first) if len(at) else np.zeros(0, np.int64)
        group = np.zeros(len(at), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        return at, group, h[order][first], e[order][first], least

    def by_bucket(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        bucket = (h >> np.uint64(64 - self.shape.bucket_bits)).astype(np.int64)
        names, cuts = np.unique(bucket, return_index=True)
        return list(zip(names.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True)) if len(h) else []


def keep_first_windows(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and the kept words, joined by one blank."""
    base = two_columns(docs, key, text)
    size = base.select(F.sum(F.octet_length("_text"))).first()[0] or 0
    shape = Shape(size, window, depth)
    base = base.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_text"), F.lit(shape.chunks)))
    by_chunk = base.groupBy("_chunk")

    def sketch(key: tuple, docs: pa.Table) -> pa.Table:
        rows = Chunk(docs, shape).sketch()
        part, cells, twice = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "slice": pa.array(part, pa.int64()), "cells": pa.array(cells, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def add_up(key: tuple, sketches: pa.Table) -> pa.Table:
        counts = np.zeros(1 << shape.slice_bits, np.uint8)
        cells = [unpack(x) for x in sketches.column("cells").to_pylist()]
        for c, twice in zip(cells, sketches.column("twice").to_pylist(), strict=True):
            counts[c] = np.minimum(counts[c] + 1 + flags(twice, len(c)), 2)
        masks = [bits(counts[c] >= 2) for c in cells]
        n = len(masks)
        return pa.table({"_chunk": sketches.column("chunk"), "part": pa.array([key[0].as_py()] * n, pa.int64()), "kind": pa.array(["mask"] * n), "flags": pa.array(masks, pa.binary()), "least": pa.array([b""] * n, pa.binary())})

    answer = "_chunk long, part long, kind string, flags binary, least binary"
    masks = by_chunk.applyInArrow(sketch, "chunk long, slice long, cells binary, twice binary").groupBy("slice").applyInArrow(add_up, answer)

    def ask(key: tuple, docs: pa.Table, masks: pa.Table) -> pa.Table:
        chunk = Chunk(docs, shape)
        _, _, h, e, least = chunk.asked(dict(zip(masks.column("part").to_pylist(), masks.column("flags").to_pylist(), strict=True)))
        cuts = chunk.by_bucket(h)
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(cuts), pa.int64()), "bucket": pa.array([b for b, _, _ in cuts], pa.int64()),
            "h": pa.array([h[a:z].tobytes() for _, a, z in cuts], pa.binary()), "e": pa.array([e[a:z].tobytes() for _, a, z in cuts], pa.binary()),
            "least": pa.array([least[a:z].tobytes() for _, a, z in cuts], pa.binary()),
        })

    def smallest(key: tuple, asked: pa.Table) -> pa.Table:
        h, e, own = ([np.frombuffer(x, t) for x in asked.column(c).to_pylist()] for c, t in (("h", np.uint64), ("e", np.uint32), ("least", np.int64)))
        order, first = grouped(np.concatenate(h), np.concatenate(e))
        flat = np.concatenate(own)
        least = np.zeros(len(flat), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(flat[order], first), np.diff(np.append(first, len(flat))))
        out, at = [], 0
        for x in own:
            some = least[at : at + len(x)]
            out.append((bits(some < x), some[some < x].tobytes()))
            at += len(x)
        n = len(out)
        return pa.table({"_chunk": asked.column("chunk"), "part": pa.array([key[0].as_py()] * n, pa.int64()), "kind": pa.array(["least"] * n), "flags": pa.array([a for a, _ in out], pa.binary()), "least": pa.array([b for _, b in out], pa.binary())})

    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(docs, shape)
        masks, smaller = {}, {}
        for part, kind, f, x in zip(*(answers.column(c).to_pylist() for c in ("part", "kind", "flags", "least")), strict=True):
            if kind == "mask":
                masks[part] = f
            else:
                smaller[part] = (f, x)
        at, group, h, _, least = chunk.asked(masks)
        for bucket, a, z in chunk.by_bucket(h):
            f, x = smaller[bucket]
            least[a:z][flags(f, z - a)] = np.frombuffer(x, np.int64)
        covered = at[least[group] < chunk.number[chunk.doc[at]]]
        edge = np.bincount(chunk.start[covered], minlength=chunk.size + 1) - np.bincount(chunk.start[covered] + shape.window, minlength=chunk.size + 1)
        gone = np.cumsum(edge)[: chunk.size] > 0
        removed, texts, at = [], [], 0
        for words, end in zip(chunk.words, chunk.ends.tolist(), strict=True):
            own = gone[at:end]
            removed.append(int(own.sum()))
            texts.append(b" ".join(itertools.compress(words, (~own).tolist()) if removed[-1] else words))
            at = end
        return pa.table({"doc_id": chunk.ids, "n_words": pa.array([len(x) for x in chunk.words], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    asked = by_chunk.cogroup(masks.groupBy("_chunk")).applyInArrow(ask, "chunk long, bucket long, h binary, e binary, least binary")
    least = asked.groupBy("bucket").applyInArrow(smallest, answer)
    return by_chunk.cogroup(masks.unionByName(least).groupBy("_chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, text string")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS k FROM g JOIN f USING (gram) WHERE first < doc_id),
t AS (SELECT doc_id, list(k) AS gone, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k))), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


@query("op10_substrings", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keep_first_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

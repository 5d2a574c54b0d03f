"""LM scoring by context-tree weighting over bytes.

A text is read as its lower-cased words, each followed by a blank, the last by a line feed (the end).  A byte is eight
binary decisions; each of the 255 places in the tree of bytes has a context tree of its own, whose contexts are the 0 to
``DEPTH`` bytes before.  A node holds the counts of its decision in the training texts and mixes its Krichevsky-Trofimov
estimate with the product of its children, half and half, down to the largest depth.  With the finished tree, a byte's
probability is the mixture over all depths on its path; what was never seen has no counts and adds the even estimate.

The tree grows with the corpus and is never in one place.  Contexts that agree in the nearest ``NEAR`` bytes form a
family, with at most 65,536 contexts below each; the levels are worked up and down in three groups of them::

    chunks of texts --distinct (context, byte), training counts--> families by 4 bytes: levels 6 and 5
      --their nodes at level 4--> families by 2 bytes: levels 4 and 3 --nodes at level 2--> levels 2 to 0
      --probabilities and remaining weights--> back down --log probability of each (context, byte)--> chunks

Counts are added where they are gathered (a chunk sends each distinct context once, however often it or a copied text
occurs).  Level 2 and above, which one task works out, has at most 65,536 contexts of 255 decisions at any corpus size.  The
rest of the exchange is proportional to the chunks' distinct contexts.  Training token counts travel the same way.

Edge cases: null and empty texts are the end alone; a null id is not held out (and learned from); rows with equal ids or
equal texts are rows of their own and count as often as they occur; with nothing to learn from, every decision is even;
extra columns play no part.  A chunk holds one text at least, so memory grows with the longest text (about 15 bytes a byte).
``docs`` should be read from files, as rows are dealt by their place.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_128_digest

from .common import blobs, mix64, query, table
from .packing import ascending, by_bucket, chained, column, cut_at, lengths, runs, unascending, unvarint, varint

DEPTH, NEAR = 6, 4
#: Bytes of text in a chunk; bytes of text for which there is one more bucket of contexts, and of words.
CHUNK, BUCKET = 16 << 20, 8 << 20
#: Buckets of the families by two bytes (65,536 families at most).
FEW = 64
#: Positions that are looked up at a time.
SLICE = 1 << 18
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"
HALF = math.log(0.5)
U8, U16 = np.uint64(8), np.uint64(16)

_small = np.append(0.0, np.cumsum(np.log(np.arange(1 << 12) + 0.5)))
_whole = np.append(0.0, np.cumsum(np.log(np.arange(1, 1 << 12))))


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_half_rising(n: np.ndarray) -> np.ndarray:
    """log of (1/2)(3/2)...(n - 1/2)."""
    large = _stirling(np.maximum(n, 1 << 11) + 0.5) - math.lgamma(0.5)
    return np.where(n < 1 << 12, _small[np.minimum(n, (1 << 12) - 1)], large)


def log_factorial(n: np.ndarray) -> np.ndarray:
    return np.where(n < 1 << 12, _whole[np.minimum(n, (1 << 12) - 1)], _stirling(np.maximum(n, 1 << 11) + 1.0))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with n0 zeros and n1 ones under the Krichevsky-Trofimov estimate."""
    return log_half_rising(n0) + log_half_rising(n1) - log_factorial(n0 + n1)


class Level:
    """Nodes of one depth, sorted by key: context, nearest byte first, then the place in the tree of bytes (1 to 255)."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        self.key, self.n0, self.n1 = key, n0, n1
        own = log_kt(n0, n1)
        #: Log of the weighted probability, and of the share of it that stops here.
        self.weighted = own if below is None else HALF + np.logaddexp(own, below)
        self.stop = np.exp(HALF + own - self.weighted) if below is not None else np.ones(len(own))

    def parents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys one byte shorter, with counts and the product of their children; the order of the children is kept in ``up``."""
        shorter = (self.key >> U16 << U8) | (self.key & np.uint64(255))
        order = np.argsort(shorter, kind="stable")
        first = runs(shorter[order])
        self.up = np.empty(len(order), np.int64)
        self.up[order] = np.repeat(np.arange(len(first)), lengths(first, len(order)))
        add = np.add.reduceat
        if not len(first):
            return shorter, self.n0, self.n1, self.weighted
        return shorter[order][first], add(self.n0[order], first), add(self.n1[order], first), add(self.weighted[order], first)

    def mixed(self, so_far: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a one gathered down to here, and the weight left for deeper contexts; given that of the parents."""
        one = (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)
        return so_far + left * self.stop * one, left * (1.0 - self.stop)


def decisions(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of sorted (context, byte) keys: node keys, counts of zeros and ones, and each key's node for each of the eight bits."""
    byte, context = key & np.uint64(255), key >> U8 << U8
    keys, zeros, ones, node, at = [], [], [], np.empty((8, len(key)), np.int64), 0
    for bit in range(8):
        place = context | np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
        one = (byte >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64)
        first = runs(place)
        keys.append(place[first])
        set_ = np.add.reduceat(count * one, first) if len(first) else count
        zeros.append(np.add.reduceat(count, first) - set_ if len(first) else count)
        ones.append(set_)
        node[bit] = at + np.repeat(np.arange(len(first)), lengths(first, len(key)))
        at += len(first)
    return np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones), node


class Family:
    """The deep levels of the contexts that a bucket holds."""

    def __init__(self, key: np.ndarray, count: np.ndarray) -> None:
        self.key = key
        nodes, n0, n1, self.node = decisions(key, count)
        self.levels = [Level(nodes, n0, n1, None)]
        for _ in range(DEPTH - NEAR - 1):
            self.levels.append(Level(*self.levels[-1].parents()))
        self.top = self.levels[-1].parents()

    def log2(self, so_far: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Log probability of each key's byte, given the mixture of the nodes above (in the order of ``top``)."""
        for level in reversed(self.levels):
            so_far, left = level.mixed(so_far[level.up], left[level.up])
        total = np.zeros(len(self.key))
        for bit in range(8):
            one = (self.key >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            p = so_far[self.node[bit]]
            total += np.log2(np.where(one, p, 1.0 - p))
        return total


class Chunk:
    """The byte stream of some documents: each text behind DEPTH line feeds."""

    def __init__(self, docs: pa.Table) -> None:
        self.held = np.array(column(docs, "_held"), bool)
        pad, stream, tokens = END * DEPTH, [], []
        for text in blobs(docs.column("_text").combine_chunks()):
            words = text.translate(LOWER).split()
            stream.append(pad + b" ".join(words) + END)
            tokens.append(len(words) + 1)
        self.tokens = np.array(tokens, np.int64)
        self.size = np.array([len(x) for x in stream], np.int64)
        self.bytes = self.size - DEPTH
        self.ends = np.cumsum(self.size)
        self.data = b"".join(stream)
        self.stream = np.frombuffer(self.data, np.uint8)

    def words(self) -> Iterator[list[bytes]]:
        """Words of one text after the other, with the end."""
        for end, size in zip(self.ends.tolist(), self.size.tolist(), strict=True):
            words = self.data[end - size : end].split()
            words.append(END)
            yield words

    def keys(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """(context, byte) of the positions from a to z that aren't padding, and their documents."""
        a, z = max(a, DEPTH), min(z, len(self.stream))
        if z <= a:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key = self.stream[a:z].astype(np.uint64)
        for k in range(1, DEPTH + 1):
            key |= self.stream[a - k : z - k].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
        from_, to = np.searchsorted(self.ends, [a, z - 1], "right").tolist()
        inside = np.minimum(self.ends[from_ : to + 1], z) - np.maximum(self.ends[from_ : to + 1] - self.size[from_ : to + 1], a)
        doc = np.repeat(np.arange(from_, to + 1), inside)
        real = np.arange(a, z) - (self.ends - self.size)[doc] >= DEPTH
        return key[real], doc[real]

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of all texts, sorted, and their counts in the training texts."""
        key, at = np.empty(int(self.bytes.sum()), np.uint64), 0
        for a in range(0, len(self.stream), SLICE):
            some, doc = self.keys(a, a + SLICE)
            key[at : at + len(some)] = some << np.uint64(1) | self.held[doc]
            at += len(some)
        key.sort()
        held = np.empty(len(key), np.uint8)
        for a in range(0, len(key), SLICE):
            held[a : a + SLICE] = key[a : a + SLICE] & np.uint64(1)
        key >>= np.uint64(1)
        first = runs(key)
        known, n = key[first], lengths(first, len(key))
        del key
        return known, n - np.add.reduceat(held, first, dtype=np.int64) if len(first) else n

    def vocabulary(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, sorted by hash; both halves of their hashes; training counts (0: only in held-out texts)."""
        counts: Counter[bytes] = Counter()
        for words, held in zip(self.words(), self.held.tolist(), strict=True):
            if held:
                for w in set(words):
                    counts.setdefault(w, 0)
            else:
                counts.update(words)
        words = list(counts)
        halves = np.frombuffer(b"".join(map(xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        h, e = halves[order, 0], halves[order, 1]
        n = np.fromiter(counts.values(), np.int64, len(words))[order]
        return [words[k] for k in order.tolist()], h, e, n

    def unigram(self, counts_of: Callable[[int], np.ndarray], buckets: int, total: float) -> tuple[np.ndarray, np.ndarray]:
        """Known tokens and log10 probability of each text, from the training counts of the words of each bucket."""
        words, h, _, _ = self.vocabulary()
        order, parts = by_bucket(h, buckets)
        counts = np.zeros(len(h), np.int64)
        for b, a, z in parts:
            counts[order[a:z]] = counts_of(b)
        number = dict(zip(words, counts.tolist(), strict=True))
        c = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(self.words())), np.int64, int(self.tokens.sum()))
        of = np.repeat(np.arange(len(self.tokens)), self.tokens)
        n = len(self.tokens)
        return np.bincount(of, c > 0, n).astype(np.int64), np.bincount(of, np.log10((c + 0.1) / total), n)

    def summed(self, logs_of: Callable[[int], np.ndarray], buckets: int) -> np.ndarray:
        """Log probability of each text, from those of the distinct keys of each bucket; some positions at a time."""
        known, _ = self.contexts()
        order, parts = by_bucket(families(known), buckets)
        logs = np.zeros(len(known), np.float32)
        for b, a, z in parts:
            logs[order[a:z]] = logs_of(b)
        total = np.zeros(len(self.tokens))
        for at in range(0, len(self.stream), SLICE):
            key, doc = self.keys(at, at + SLICE)
            order = np.argsort(key)
            key = key[order]
            first = runs(key)
            values = np.repeat(logs[np.searchsorted(known, key[first])], lengths(first, len(key)))
            total += np.bincount(doc[order], values, len(total))
        return total


def families(keys: np.ndarray) -> np.ndarray:
    """Mixed hash of the nearest bytes of (context, byte) keys."""
    return mix64(keys >> np.uint64(8 * (DEPTH - NEAR + 1)))


NODES = "bucket long, back long, key binary, n0 binary, n1 binary, below binary"
MIXED = "bucket long, key binary, so_far binary, left binary"
ANSWER = "_chunk long, bucket long, value binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _nodes(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, family: np.ndarray, buckets: int, back: int) -> pa.Table:
    order, parts = by_bucket(mix64(family), buckets)
    key, n0, n1, below = key[order], n0[order], n1[order], below[order]
    parts = list(parts)
    return pa.table({
        "bucket": pa.array([b for b, _, _ in parts], pa.int64()), "back": pa.array([back] * len(parts), pa.int64()),
        "key": pa.array([ascending(key[a:z]) for _, a, z in parts], pa.binary()),
        "n0": pa.array([varint(n0[a:z]) for _, a, z in parts], pa.binary()), "n1": pa.array([varint(n1[a:z]) for _, a, z in parts], pa.binary()),
        "below": pa.array([below[a:z].tobytes() for _, a, z in parts], pa.binary()),
    })


def _gathered(nodes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that several tasks sent, sorted, and the row of the table that each came with."""
    key = [unascending(x).astype(np.uint64) for x in column(nodes, "key")]
    row = np.repeat(np.arange(len(key)), [len(k) for k in key])
    n0, n1 = (chained([unvarint(x) for x in column(nodes, c)], np.int64) for c in ("n0", "n1"))
    below = chained([np.frombuffer(x, np.float64) for x in column(nodes, "below")], np.float64)
    key = chained(key, np.uint64)
    order = np.argsort(key, kind="stable")
    return key[order], n0[order], n1[order], below[order], row[order]


def _mixed_above(rows: pa.Table, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixture of the nodes ``key``, out of the rows that hold all of them."""
    keys = chained([unascending(x).astype(np.uint64) for x in column(rows, "key")], np.uint64)
    so_far, left = (chained([np.frombuffer(x, np.float64) for x in column(rows, c)], np.float64) for c in ("so_far", "left"))
    order = np.argsort(keys, kind="stable")
    at = order[np.searchsorted(keys[order], key)]
    return so_far[at], left[at]


def _mixed_rows(bucket: list[int], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    return pa.table({
        "bucket": pa.array(bucket, pa.int64()), "key": pa.array([ascending(k) for k, _, _ in parts], pa.binary()),
        "so_far": pa.array([p.tobytes() for _, p, _ in parts], pa.binary()), "left": pa.array([w.tobytes() for _, _, w in parts], pa.binary()),
    })


def _counted(sent: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct (context, byte) keys of a bucket with training counts, and the place among them of each row's keys."""
    keys = [unascending(x).astype(np.uint64) for x in column(sent, "key")]
    n = chained([unvarint(x) for x in column(sent, "n")], np.int64)
    key = chained(keys, np.uint64)
    order = np.argsort(key, kind="stable")
    first = runs(key[order])
    place = np.empty(len(key), np.int64)
    place[order] = np.repeat(np.arange(len(first)), lengths(first, len(key)))
    total = np.add.reduceat(n[order], first) if len(first) else n
    return key[order][first], total, list(cut_at(place, [len(k) for k in keys]))


def _words(sent: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts of a bucket's distinct words, and the place among them of each row's words."""
    h, e = ([np.frombuffer(x, np.uint64) for x in column(sent, c)] for c in ("key", "more"))
    n, first_half, second = chained([unvarint(x) for x in column(sent, "n")], np.int64), chained(h, np.uint64), chained(e, np.uint64)
    order = np.lexsort((second, first_half))
    a, b = first_half[order], second[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    place = np.empty(len(a), np.int64)
    place[order] = np.repeat(np.arange(len(first)), lengths(first, len(a)))
    total = np.add.reduceat(n[order], first) if len(first) else n
    return total, list(cut_at(place, [len(x) for x in h]))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``held_out`` is a boolean SQL expression over ``docs``; such rows are scored but not learned from.  ``base_score`` is the
    unigram score with 0.1 added to each count, ``score`` the tree's; both are log10 probabilities of the whole text.
    """
    held = F.expr(held_out) if held_out else F.lit(False)
    base = docs.select(
        F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
        F.coalesce(held, F.lit(False)).alias("_held"),
    )
    size = base.select(F.sum(F.octet_length("_text"))).first()[0] or 0
    chunks, buckets = max(1, math.ceil(size / CHUNK)), max(1, math.ceil(size / BUCKET))
    base = base.withColumn("_chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)))
    by_chunk = base.groupBy("_chunk")

    def gather(key: tuple, docs: pa.Table) -> pa.Table:
        """Contexts go to buckets from 0, words to buckets from ``buckets`` on."""
        chunk = Chunk(docs)
        keys, n = chunk.contexts()
        order, parts = by_bucket(families(keys), buckets)
        keys, n = keys[order], n[order]
        rows = [(b, ascending(keys[a:z]), b"", varint(n[a:z])) for b, a, z in parts]
        _, h, e, n = chunk.vocabulary()
        order, parts = by_bucket(h, buckets)
        h, e, n = h[order], e[order], n[order]
        rows += [(buckets + b, h[a:z].tobytes(), e[a:z].tobytes(), varint(n[a:z])) for b, a, z in parts]
        b, k, m, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "bucket": pa.array(b, pa.int64()), "key": pa.array(k, pa.binary()), "more": pa.array(m, pa.binary()), "n": pa.array(n, pa.binary())})

    def deep_up(key: tuple, sent: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= buckets:  # words: their number and that of distinct ones, to the top
            total, _ = _words(sent)
            both = np.array([total.sum(), (total > 0).sum()])
            return pa.table({"bucket": [-1], "back": [-1], "key": pa.array([b""], pa.binary()), "n0": pa.array([varint(both)], pa.binary()), "n1": pa.array([b""], pa.binary()), "below": pa.array([b""], pa.binary())})
        keys, n, _ = _counted(sent)
        node, n0, n1, below = Family(keys, n).top
        return _nodes(node, n0, n1, below, node >> np.uint64(8 * (NEAR - 2) + 8), FEW, bucket)

    def middle(nodes: pa.Table) -> tuple[list[Level], tuple, np.ndarray]:
        node, n0, n1, below, row = _gathered(nodes)
        levels = [Level(node, n0, n1, below)]
        for _ in range(NEAR - 3):
            levels.append(Level(*levels[-1].parents()))
        return levels, levels[-1].parents(), row

    def middle_up(key: tuple, nodes: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return nodes
        _, (node, n0, n1, below), _ = middle(nodes)
        return _nodes(node, n0, n1, below, np.zeros(len(node), np.uint64), 1, key[0].as_py())

    def top(nodes: pa.Table) -> pa.Table:
        """Levels 2 to 0; and the numbers of words, for every chunk."""
        words = [k < 0 for k in column(nodes, "bucket")]
        total = sum((unvarint(x) for x, w in zip(column(nodes, "n0"), words, strict=True) if w), np.zeros(2, np.int64))
        nodes = nodes.filter(pa.array([not w for w in words], pa.bool_()))
        node, n0, n1, below, row = _gathered(nodes)
        levels = [Level(node, n0, n1, below)]
        for _ in range(2):
            levels.append(Level(*levels[-1].parents()))
        so_far, left = levels[-1].mixed(np.zeros(len(levels[-1].key)), np.ones(len(levels[-1].key)))
        for level in reversed(levels[:-1]):
            so_far, left = level.mixed(so_far[level.up], left[level.up])
        back = column(nodes, "back")
        parts = [(node[row == k], so_far[row == k], left[row == k]) for k in range(len(back))]
        down = _mixed_rows(back, parts)
        nothing = pa.array([b""] * chunks, pa.binary())
        told = pa.table({"bucket": pa.array([-1 - c for c in range(chunks)], pa.int64()), "key": pa.array([varint(total)] * chunks, pa.binary()), "so_far": nothing, "left": nothing})
        return pa.concat_tables([down, told])

    def middle_down(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # numbers of words
            return _mixed_rows([], [])
        levels, up, row = middle(nodes)
        so_far, left = _mixed_above(above, up[0])
        for level in reversed(levels):
            so_far, left = level.mixed(so_far[level.up], left[level.up])
        order = np.argsort(row, kind="stable")
        back = column(nodes, "back")
        sizes = np.bincount(row, minlength=len(back)).tolist()
        parts = list(zip(*(cut_at(x[order], sizes) for x in (levels[0].key, so_far, left)), strict=True))
        return _mixed_rows(back, parts)

    def deep_down(key: tuple, sent: pa.Table, above: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= buckets:
            total, place = _words(sent)
            values = [varint(total[p]) for p in place]
        else:
            keys, n, place = _counted(sent)
            family = Family(keys, n)
            logs = family.log2(*_mixed_above(above, family.top[0])).astype(np.float32)
            values = [logs[p].tobytes() for p in place]
        return pa.table({"_chunk": sent.column("chunk"), "bucket": pa.array([bucket] * len(values), pa.int64()), "value": pa.array(values, pa.binary())})

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(docs)
        got = dict(zip(column(answers, "bucket"), column(answers, "value"), strict=True))
        train, distinct = unvarint(got[-1]).tolist()
        n_known, base_score = chunk.unigram(lambda b: unvarint(got[buckets + b]), buckets, train + 0.1 * (distinct + 1))
        log10 = chunk.summed(lambda b: np.frombuffer(got[b], np.float32), buckets) * math.log10(2)
        n = len(chunk.tokens)
        return pa.table({
            "doc_id": docs.column("_id"), "held_out": pa.array(chunk.held, pa.bool_()), "n_tokens": pa.array(chunk.tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([train] * n, pa.int64()),
            "base_score": pa.array(base_score, pa.float64()), "score": pa.array(log10, pa.float64()),
            "bits_per_byte": pa.array(-log10 / math.log10(2) / np.maximum(chunk.bytes, 1), pa.float64()),
        })

    sent = by_chunk.applyInArrow(gather, "chunk long, bucket long, key binary, more binary, n binary").groupBy("bucket")
    nodes = sent.applyInArrow(deep_up, NODES).groupBy("bucket")
    summit = nodes.applyInArrow(middle_up, NODES).withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(top, MIXED)
    above = nodes.cogroup(summit.groupBy("bucket")).applyInArrow(middle_down, MIXED)
    told = summit.where("bucket < 0").select((-1 - F.col("bucket")).alias("_chunk"), F.lit(-1).cast("long").alias("bucket"), F.col("key").alias("value"))
    answers = sent.cogroup(above.groupBy("bucket")).applyInArrow(deep_down, ANSWER).unionByName(told)
    return by_chunk.cogroup(answers.groupBy("_chunk")).applyInArrow(finish, RESULT)


@query("op12_context_tree")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), held_out="crc32(cast(doc_id AS string)) % 10 = 0")

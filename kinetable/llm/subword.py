"""SentencePiece encoding and decoding with a unigram model.

The pieces stand in a double-array trie over bytes; a text is cut into the pieces with the largest sum of
log scores (Viterbi).  A blank is the whitespace marker, a text gets one marker in front, and characters
without a piece fall back to one id per byte.

The vocabulary is read from a SentencePiece model file and never trained.  If the file stores merge ranks
instead of log scores (a BPE vocabulary), ``scores="zipf"`` turns rank r into ``-ln(r + 2)``;
``scores="stored"`` takes the numbers as they are.

A piece holds the marker only at its front (checked when a model is loaded), so the best path of a text
joins the best paths of its parts that begin with blanks.  Parts repeat, so their ids are kept in a
cache of the task, bounded in bytes.

Edge cases: null is encoded as the empty text and gives no ids; a literal U+2581 is the marker and comes
back as a blank (``round_trip`` is then false); all other texts come back exactly, however long; repeated rows are
encoded alike; of equal paths the one whose last piece is longer wins; other columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blobs, query, slices, table, two_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
PARTS = re.compile(rb" +[^ ]*")
#: Parts longer than this are neither batched nor kept.
LONG = 64
#: Most parts kept by a task, each of at most LONG bytes: some 16 MB with their ids.
KEPT = 60_000
#: Bytes of text encoded at a time.
STEP = 4 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, stored score, type) of a model file, in the order of the ids."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return out


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """-ln(rank + 2), rank by stored score; equal scores share the rank of the first."""
    ordered = sorted({s for _, s, t in pieces if t in (NORMAL, USER)}, reverse=True)
    rank = {s: k for k, s in enumerate(ordered)}
    return [-math.log(rank[s] + 2) if t in (NORMAL, USER) else 0.0 for _, s, t in pieces]


class DoubleArray:
    """Trie over bytes: ``base[s] + c`` is the state behind ``s`` if ``check`` there says ``s``."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        words = sorted(keys)
        size = 1 << 16
        while size < 8 * sum(map(len, words)) + 1024:
            size *= 2
        base, check, value = [0] * size, [-1] * size, [-1] * size
        taken = bytearray(size)
        taken[0] = 1
        free, roomy = 257, 257  # the first free state (no base is below 1), and where a search for room for several children begins
        todo = [(0, 0, len(words), 0)]
        for state, low, high, depth in todo:
            if len(words[low]) == depth if low < high else False:
                value[state] = keys[words[low]]
                low += 1
            if low >= high:
                continue
            children, at = [], low
            while at < high:
                c, first = words[at][depth], at
                while at < high and words[at][depth] == c:
                    at += 1
                children.append((c, first, at))
            while taken[free]:
                free += 1
            least = children[0][0]
            spot = free if len(children) == 1 else max(free, roomy)
            tried = 1
            while taken[spot] or any(taken[spot - least + c] for c, _, _ in children):
                spot += 1
                tried += 1
            if len(children) > 1 and tried > 32:
                roomy = spot
            b = base[state] = spot - least
            for c, first, last in children:
                taken[b + c] = 1
                check[b + c] = state
                todo.append((b + c, first, last, depth + 1))
        used = max(s for s in range(size) if taken[s]) + 257
        self.base, self.check, self.value = (np.array(x[:used], np.int32) for x in (base, check, value))
        self.depth = max(map(len, words), default=0)


class Unigram:
    """Encoder and decoder of one model; small and the same for any amount of data."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: list[float]) -> None:
        self.name = hashlib.sha256(repr((pieces, scores)).encode()).hexdigest()
        self.texts = [p.encode().replace(MARK, b" ") if t in (NORMAL, USER) else b"" for p, _, t in pieces]
        keys: dict[bytes, int] = {}
        for k, (_, _, t) in enumerate(pieces):
            if t in (NORMAL, USER) and self.texts[k]:
                keys.setdefault(self.texts[k], k)
        self.whole = any(b" " in key.lstrip(b" ") for key in keys)
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = [self.unknown] * 256
        self.is_byte = np.zeros(len(pieces), bool)
        for k, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                c = int(p[3:5], 16)
                self.byte_ids[c], self.texts[k], self.is_byte[k] = k, bytes([c]), True
        self.scores = np.array(scores, np.float64)
        self.missing = float(min(self.scores[list(keys.values())], default=0.0)) - 10.0
        self.trie = DoubleArray(keys)

    # encoding

    def encode_parts(self, parts: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids (int32, as bytes) of each part."""
        out, short = {}, {}
        for p in parts:
            if len(p) > LONG:
                out[p] = self._one(p)
            else:
                short.setdefault((len(p) + 7) // 8, []).append(p)
        for eighth, words in short.items():
            for k in range(0, len(words), 20_000):
                some = words[k : k + 20_000]
                out.update(zip(some, self._many(some, eighth * 8), strict=True))
        return out

    def _many(self, words: list[bytes], width: int) -> list[bytes]:
        """Viterbi over many parts at a time, one trie step per turn."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(words)
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), np.int64, n)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, width + 1), np.int32)
        token = np.full((n, width + 1), -1, np.int32)
        head = text[:, :]
        char = np.where(head < 0x80, 1, np.where(head < 0xE0, 2, np.where(head < 0xF0, 3, 4)))
        for i in range(width):
            rows = np.flatnonzero((length > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            start, own = best[rows, i], np.minimum(char[rows, i], length[rows] - i)
            single = np.zeros(len(rows), bool)
            at, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, min(width, i + self.trie.depth)):
                to = base[state] + text[rows[at], j]
                good = (check[to] == state) & (length[rows[at]] > j)
                at, state = at[good], to[good]
                if not len(at):
                    break
                ends = value[state] >= 0
                if ends.any():
                    k, piece = at[ends], value[state[ends]]
                    single[k[own[k] == j + 1 - i]] = True
                    self._better(best, back, token, rows[k], j + 1, start[k] + self.scores[piece], i, piece)
            k = np.flatnonzero(~single)
            for w in (1, 2, 3, 4):
                some = k[own[k] == w]
                if len(some):
                    self._better(best, back, token, rows[some], i + w, start[some] + self.missing, i, -1)
        starts, tokens = back.tolist(), token.tolist()
        out = []
        for w, size, s, t in zip(words, length.tolist(), starts, tokens, strict=True):
            ids = []
            while size > 0:
                if t[size] >= 0:
                    ids.append(t[size])
                else:
                    ids += [self.byte_ids[c] for c in reversed(w[s[size] : size])]
                size = s[size]
            out.append(struct.pack(f"<{len(ids)}i", *reversed(ids)))
        return out

    @staticmethod
    def _better(best, back, token, rows, end, score, start, piece) -> None:
        wins = score > best[rows, end]
        rows = rows[wins]
        best[rows, end] = score[wins]
        back[rows, end] = start
        token[rows, end] = piece[wins] if isinstance(piece, np.ndarray) else piece

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lists"}

    @functools.cached_property
    def _lists(self):
        """Trie and scores as views, whose items are plain numbers."""
        return tuple(memoryview(np.ascontiguousarray(x)) for x in (self.trie.base, self.trie.check, self.trie.value, self.scores))

    def _one(self, w: bytes) -> bytes:
        """The same for one part of any length; 20 bytes of memory a byte."""
        base, check, value, scores = self._lists
        n = len(w)
        best, back, token = array("d", [-math.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -math.inf:
                continue
            c = w[i]
            own = min(1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4, n - i)
            state, single = 0, False
            for j in range(i, n):
                to = base[state] + w[j]
                if check[to] != state:
                    break
                state = to
                piece = value[state]
                if piece >= 0:
                    single = single or j + 1 - i == own
                    if (score := best[i] + scores[piece]) > best[j + 1]:
                        best[j + 1], back[j + 1], token[j + 1] = score, i, piece
            if not single and (score := best[i] + self.missing) > best[i + own]:
                best[i + own], back[i + own], token[i + own] = score, i, -1
        ids = array("i")
        while n > 0:
            if token[n] >= 0:
                ids.append(token[n])
            else:
                ids.extend([self.byte_ids[c] for c in reversed(w[back[n] : n])])
            n = back[n]
        ids.reverse()
        return ids.tobytes()

    def encode(self, texts: list[bytes], cache: dict[bytes, bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8)."""
        split = []
        for x in texts:
            x = b" " + (x.replace(MARK, b" ") if MARK in x else x) if x else b""
            split.append([x] if self.whole and x else PARTS.findall(x))
        wanted = set().union(*split) if split else set()
        fresh = self.encode_parts(w for w in wanted if w not in cache)
        del wanted
        fresh_or = fresh.get
        out = [np.frombuffer(b"".join([cache.get(w) or fresh_or(w) for w in parts]), np.int32) for parts in split]
        for w, ids in fresh.items():
            if len(cache) < KEPT and len(w) <= LONG:
                cache[w] = ids
        return out

    # decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids; ids without text give nothing, bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.texts.__getitem__, ids.tolist()))
        data = data[1:] if data.startswith(b" ") else data
        return data.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=4)
def load(path: str = MODEL, scores: str = "zipf") -> Unigram:
    pieces = read_pieces(path)
    return Unigram(pieces, zipf_scores(pieces) if scores == "zipf" else [s for _, s, _ in pieces])


def encode_texts(docs: DataFrame, model: Unigram | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row. Narrow; the model is broadcast (its size is that of the vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache: dict[bytes, bytes] = {}
        for batch in slices(batches, "_text", STEP):
            ids = m.encode(blobs(batch.column("_text")), cache)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: Unigram | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids give null, ids outside the vocabulary nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for x in batch.column("_ids"):
                if not x.is_valid:
                    out.append(None)
                    continue
                v = x.values.drop_null().to_numpy(zero_copy_only=False)
                out.append(m.decode(v[(v >= 0) & (v < len(m.texts))]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return encoded.selectExpr(f"cast(`{key}` as long) AS _id", f"cast(`{ids}` as array<int>) AS _ids").mapInArrow(run, "doc_id long, text string")


CODED = "doc_id long, n_ids long, n_byte_ids long, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_and_check(docs: DataFrame, model: Unigram | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text and decode its ids again in one pass: ids, digests of the ids (little-endian int32) and of the decoded text, and whether it is the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache: dict[bytes, bytes] = {}
        for batch in slices(batches, "_text", STEP):
            texts = blobs(batch.column("_text"))
            ids = m.encode(texts, cache)
            again = [m.decode(x) for x in ids]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = [
                batch.column("_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(m.is_byte[x].sum()) for x in ids], pa.int64()),
                pa.ListArray.from_arrays(ends, flat), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in again], pa.string()), pa.array([a == b for a, b in zip(texts, again, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CODED.split(", ")])

    return two_columns(docs, key, text).mapInArrow(run, CODED)


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(table(spark, sf_dir, "documents"))

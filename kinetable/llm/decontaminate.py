"""Benchmark decontamination with a distributed positional inverted index.

The training documents are indexed once, in segments of some thousand documents: a segment is a row with
its documents and, for every term that the benchmark uses, the posting list of (document, position).  Terms
outside the benchmark's vocabulary take a position but have no list, as no test term can ask for them.

A test item is cut into windows of consecutive words.  For each window the segment's lists are intersected
from the rarest term on (rarest by occurrences in all documents): the rarest list gives the starts, shifted by
the term's offset in the window, and each further term removes the starts that its own shifted list lacks.
What is left after all terms is an exact phrase match; starts of which most terms are found
within ``SLACK`` positions are proximity matches.  As some terms may be missing there, their starts come from the lists of
as many of the rarest terms as must have one in any such place; each occurrence tells the best start around it.

Benchmark terms and windows go to the tasks in blocks of at most ``BLOCK_WORDS`` words, each block of items in a pass
over the stored index, so that what is broadcast is bounded however large the benchmark is; the vocabulary filter is
dropped (all terms are indexed) where the vocabulary exceeds ``VOCABULARY`` terms.

Edge cases: null and empty texts have no words and no hits; items without words have no windows; an item shorter
than a window is one window of its own length; repeated items all count, repeated documents are judged alike;
null item ids hit words but aren't listed; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from .common import blobs, free_name, lowered_words, query, slices, table, two_columns, written

WINDOW = 10
#: Bytes of text in a segment, at most but for longer documents.
SEGMENT = 1 << 20
#: Benchmark words broadcast at a time, and terms for which postings are filtered.
BLOCK_WORDS, VOCABULARY = 4_000_000, 4_000_000
#: A proximity match finds this share of a window's terms within so many positions of their places.
SHARE, SLACK = 0.8, 2
#: Candidate places that are judged at a time.
PLACES = 1 << 18

SEGMENTS = "segment long, doc_ids array<long>, n_words array<int>, terms array<long>, offsets array<int>, postings array<int>"


def vocabulary(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct terms (64-bit hashes) of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = {_term(w) for data in blobs(batch.column("_text")) for w in lowered_words(data)}
            yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.int64())], ["term"])

    return two_columns(benchmark, key, text).mapInArrow(run, "term long").distinct()


def _term(word: bytes) -> int:
    value = xxh3_64_intdigest(word)
    return value - (1 << 64) if value >= 1 << 63 else value


def build_index(docs: DataFrame, terms: DataFrame | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment: documents, their word counts and the posting lists of the wanted terms.

    ``offsets[i]:offsets[i + 1]`` of ``postings`` are the places of ``terms[i]`` (sorted), counted through the segment's
    documents one after the other.  Narrow; the wanted terms are broadcast, or all are indexed if ``terms`` is None.
    """
    wanted, segment = None, SEGMENT
    if terms is not None:
        wanted = docs.sparkSession.sparkContext.broadcast({r.term for r in terms.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted is not None else None
        known: dict[bytes, int] = {}
        ids: dict[int, int] = {}
        number = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "_text", segment)):
            if len(known) > 200_000:
                known.clear()
                ids.clear()
            split = [lowered_words(x) for x in blobs(batch.column("_text"))]
            for w in set().union(*split) - known.keys():
                t = _term(w)
                known[w] = ids.setdefault(t, len(ids)) if keep is None or t in keep else -1
            n = np.array([len(x) for x in split], np.int32)
            local = np.fromiter((known[w] for words in split for w in words), np.int64, int(n.sum()))
            places = np.flatnonzero(local >= 0)
            order = np.argsort(local[places], kind="stable")
            places, local = places[order], local[places[order]]
            used, first = np.unique(local, return_index=True)
            names = np.fromiter(ids, np.int64, len(ids))[used]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number + k], pa.int64()), _one(batch.column("_id")), _one(n), _one(names), _one(np.append(first, len(places)).astype(np.int32)), _one(places.astype(np.int32))],
                [f.split()[0] for f in SEGMENTS.split(", ")],
            )

    return two_columns(docs, key, text).mapInArrow(run, SEGMENTS)


def _one(values) -> pa.Array:
    """An array with one row, the list of all values."""
    flat = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def frequencies(index: DataFrame) -> DataFrame:
    """Occurrences of each indexed term in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for terms, offsets in zip(batch.column("terms"), batch.column("offsets"), strict=True):
                total.update(dict(zip(terms.values.to_pylist(), np.diff(offsets.values.to_numpy()).tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return index.select("terms", "offsets").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Windows:
    """The windows of a block of items, distinct, with the terms of each in the order in which lists are intersected."""

    def __init__(self, items: list[tuple[int | None, bytes]], often: dict[int, int], window: int) -> None:
        found: dict[tuple[int, ...], list[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            terms = [_term(w) for w in lowered_words(text)]
            for a in range(max(1, len(terms) - window + 1)) if terms else ():
                found.setdefault(tuple(terms[a : a + window]), []).append(k)
        self.size = np.array([len(w) for w in found], np.int64)
        self.owners = [np.array(sorted(set(v)), np.int64) for v in found.values()]
        width = int(self.size.max(initial=1))
        self.terms = np.zeros((len(found), width), np.int64)
        self.offset = np.full((len(found), width), -1, np.int64)
        for k, w in enumerate(found):
            order = sorted(range(len(w)), key=lambda a: (often.get(w[a], 0), w[a], a))
            self.terms[k, : len(w)] = [w[a] for a in order]
            self.offset[k, : len(w)] = order

    def matches(self, n_words: np.ndarray, terms: np.ndarray, offsets: np.ndarray, postings: np.ndarray, near: bool):
        """(window, document, start, exact) of the places in one segment; a proximity match may stand out over a document's ends."""
        total = int(n_words.sum())
        if not len(self.size) or not len(terms) or not total:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        by_name = np.argsort(terms, kind="stable")
        names = terms[by_name]
        spot = np.minimum(np.searchsorted(names, self.terms), len(names) - 1)
        local = np.where((names[spot] == self.terms) & (self.offset >= 0), by_name[spot], -1)
        # lists answer "is this place in the list of that term" by the term at each place
        at_place = np.full(total, -2, np.int64)
        at_place[postings] = np.repeat(np.arange(len(terms)), np.diff(offsets))
        doc_end = np.cumsum(n_words)
        rare = np.flatnonzero(((local >= 0) | (self.offset < 0)).all(axis=1))
        found = [self._exact(part, places, local, at_place, doc_end, n_words) for part, places in _listed(rare, local[rare, 0], offsets, postings)]
        if near:
            most = np.maximum(2, np.ceil(SHARE * self.size)).astype(np.int64)
            fit = ((local >= 0).sum(axis=1) >= most) & (self.size >= most)
            for k in range(self.terms.shape[1]):
                rare = np.flatnonzero(fit & (k <= self.size - most) & (local[:, k] >= 0))
                found += [self._near(part, places, k, most, local, at_place, doc_end, n_words) for part, places in _listed(rare, local[rare, k], offsets, postings)]
        window, doc, start, exact = (np.concatenate([np.zeros(0, t), *(f[c] for f in found)]) for c, t in enumerate((np.int64, np.int64, np.int64, bool)))
        # one of each place, an exact match before a proximity match there
        order = np.lexsort((~exact, start, doc, window))
        window, doc, start, exact = window[order], doc[order], start[order], exact[order]
        first = np.ones(len(window), bool)
        first[1:] = (window[1:] != window[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
        return window[first], doc[first], start[first], exact[first]

    def _exact(self, window, places, local, at_place, doc_end, n_words):
        """Exact matches among the places of each window's rarest term."""
        start = places - self.offset[window, 0]
        doc = np.searchsorted(doc_end, places, "right")
        keep = np.flatnonzero((start >= doc_end[doc] - n_words[doc]) & (start + self.size[window] <= doc_end[doc]))
        for k in range(1, self.terms.shape[1]):
            if not len(keep):
                break
            off = self.offset[window[keep], k]
            ok = (off < 0) | (at_place[np.minimum(start[keep] + off, len(at_place) - 1)] == local[window[keep], k])
            keep = keep[ok]
        return window[keep], doc[keep], start[keep], np.ones(len(keep), bool)

    def _near(self, window, places, anchor, most, local, at_place, doc_end, n_words):
        """The best start around each place of the windows' term ``anchor`` at which enough terms are found."""
        start = places - self.offset[window, anchor]
        doc = np.searchsorted(doc_end, places, "right")
        begin, end = doc_end[doc] - n_words[doc], doc_end[doc]
        shifts = range(-SLACK, SLACK + 1)
        count = np.zeros((len(window), len(shifts)), np.int8)
        for k in range(self.terms.shape[1]):
            term, off = local[window, k], self.offset[window, k]
            there = np.zeros((len(window), 4 * SLACK + 1), bool)
            for d in range(-2 * SLACK, 2 * SLACK + 1):
                place = start + off + d
                there[:, d + 2 * SLACK] = (term >= 0) & (place >= begin) & (place < end) & (at_place[np.clip(place, 0, len(at_place) - 1)] == term)
            for j in range(len(shifts)):
                count[:, j] += there[:, j : j + 2 * SLACK + 1].any(axis=1)
            # no start that has missed too many terms can be one
            open_ = count.max(axis=1) + np.maximum(self.size[window] - k - 1, 0) >= most[window]
            window, doc, start, begin, end, count = (x[open_] for x in (window, doc, start, begin, end, count))
        rank = count.astype(np.int64) * (SLACK + 1) - np.abs(np.array(shifts))
        return window, doc, start + np.argmax(rank, axis=1) - SLACK, np.zeros(len(window), bool)


def _listed(windows: np.ndarray, lists: np.ndarray, offsets: np.ndarray, postings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places in the list of each window, in parts of about ``PLACES`` (window, place) pairs."""
    low, many = offsets[lists].astype(np.int64), (offsets[lists + 1] - offsets[lists]).astype(np.int64)
    ends, at = np.cumsum(many), 0
    while at < len(windows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")))
        n = many[at:to]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
        yield np.repeat(windows[at:to], n), postings[entry].astype(np.int64)
        at = to


HITS = "segment long, place int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<long>, exact array<boolean>"


def look_up(index: DataFrame, windows: Windows, near: bool = False) -> DataFrame:
    """One row per document, told apart by its segment and place in it: the matched places (``starts``, ``ends``: words from 0) with the item and whether exact. Narrow."""
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n, terms, offsets, postings = (batch.column(c)[row].values for c in range(1, 6))
                n = n.to_numpy()
                window, doc, start, exact = w.matches(n, terms.to_numpy(), offsets.to_numpy(), postings.to_numpy(), near)
                owners = [w.owners[k] for k in window]
                many = np.array([len(o) for o in owners], np.int64)
                item = np.concatenate(owners) if owners else np.zeros(0, np.int64)
                doc, start, exact, size = np.repeat(doc, many), np.repeat(start, many), np.repeat(exact, many), np.repeat(w.size[window], many)
                ends = np.cumsum(n)
                order = np.lexsort((item, start, doc))
                doc, start, item, exact, size = doc[order], start[order], item[order], exact[order], size[order]
                first = start - (ends - n)[doc]
                last = np.minimum(first + size, n[doc])
                first = np.maximum(first, 0)
                bounds = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
                names = pa.array(w.items, pa.int64()).take(pa.array(item))
                lists = [pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), names, pa.array(exact)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch.column(0)[row].as_py(), np.int64)), pa.array(np.arange(len(n), dtype=np.int32)), ids, pa.array(n.astype(np.int64)), *(pa.ListArray.from_arrays(bounds, x) for x in lists)], [f.split()[0] for f in HITS.split(", ")])

    return index.mapInArrow(run, HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: bool = False) -> DataFrame:
    """One row per row of ``docs`` with all its matches (see ``look_up``)."""
    words = benchmark.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n // 4 + 1
    terms = written(vocabulary(benchmark), "benchmark-terms")
    index = written(build_index(docs, terms if terms.count() <= VOCABULARY else None), "training-index")
    blocks = math.ceil(words / BLOCK_WORDS)
    items = two_columns(benchmark, "item_id").withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)))
    # terms that the block's items use, at most BLOCK_WORDS
    counted = written(frequencies(index), "term-frequencies")
    parts = []
    for block in range(blocks):
        own = items.where(F.col("_block") == block)
        often = {r.term: r.n for r in counted.join(vocabulary(own, "_id", "_text"), "term", "left_semi").toLocalIterator()}
        rows = sorted(((r._id, r._text.encode()) for r in own.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        parts.append(look_up(index, Windows(rows, often, window), near))
    if blocks == 1:
        return parts[0].drop("segment", "place")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items", "exact")]
    # a place in a segment has as many rows as there are blocks, all of one document
    return whole.groupBy("segment", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists).drop("segment", "place")


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> int:
    """Words of a document of ``n`` that lie in at least one place."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, end, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def summarised(hits: DataFrame, near: bool = False) -> DataFrame:
    """Counts and digest of the exact matches: one row per document.

    With ``near``, also those of the proximity matches: words in them, and items that are matched so and not exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                start, end, item, exact = (batch.column(c)[k].values for c in ("starts", "ends", "items", "exact"))
                good = exact.to_numpy(zero_copy_only=False).astype(bool)
                n, n_hit, told, n_near, close = batch.column("n_words")[k].as_py(), 0, [], 0, []
                if len(good):
                    start, end, item = start.to_numpy(), end.to_numpy(), item.to_pylist()
                    n_hit = _covered(n, start[good], end[good]) if good.any() else 0
                    told = sorted({str(i) for i, g in zip(item, good, strict=True) if g and i is not None})
                    if near:
                        n_near = _covered(n, start[~good], end[~good])
                        close = sorted({str(i) for i, g in zip(item, good, strict=True) if not g and i is not None} - set(told))
                out.append((n_hit, len(told), hashlib.sha256(",".join(told).encode()).hexdigest(), n_hit > 0, n_near, ",".join(close)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            cols, types = cols[: 6 if near else 4], [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + (", n_near long, near_items string" if near else "")
    names = [f.split()[0] for f in schema.split(", ")]
    return hits.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs.

    Only ids of contaminated documents are joined; rows with a null id are judged by their text's hash.
    """
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    bad = summarised(decontaminate(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, window)).where("contaminated")
    return keyed.join(bad.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, s, p.n FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query("op6_decontaminate", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op6_proximity")
def op6_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_decontaminate, with the proximity matches in two more."""
    return summarised(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True), near=True)

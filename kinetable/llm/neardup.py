"""MinHash near-dedup on SetSketch registers.

A document is the set of its word shingles.  Its sketch has ``ROWS`` x bands registers: register i is the
truncated, exponentially spaced minimum of the shingles' exponential hash values (base ``B``, rate ``A``, ``Q`` steps), so that
sketches of parts merge by maximum and two registers are equal with a probability near the Jaccard similarity.

1. Documents with equal sets are one class, stood for by its smallest id.
2. Bands of ``ROWS`` registers deal the classes into buckets.  There are as many bands as make the chance to miss a pair
   at the threshold less than one in a million.
3. Every member of a bucket is paired with the bucket's smallest id; pairs whose similarity, estimated from both
   sketches by maximum likelihood (set sizes known), stays ``MARGIN`` below the threshold are left out; the rest is
   verified on the full sets.  Verified links give components.
4. Buckets that still hold several components are searched, block of members against block of members, for members that
   have a partner in another component with a sufficient estimate (in the first band that the two share).  Only their
   texts are fetched, and all their pairs in a block are verified at a time, by counting common shingles as a product of
   incidence matrices.  Members of one component need no comparison, and a block gives at most one row per
   member (the smallest it reaches), so that neither pairs nor links of large groups are listed, and none is lost.

Hot classes and buckets: classes and leaders are aggregated before they are shuffled and written, so joins on hot keys are
plain ones that the engine splits; blocks bound what a task compares.

Edge cases: null and empty texts have no shingles, link with nothing and are kept; a text shorter than a
shingle is one shingle; rows with a null id link with nothing and are kept, with a null component; rows with equal
ids are one document; extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import blobs, free_name, mix64, query, slices, table, two_columns, written
from .components import components, least_reached

ROWS = 4
A, B, Q = 20.0, 1.001, (1 << 16) - 2
MISS = 1e-6
#: Estimates err by 0.04 at the thresholds in use; this is six times that.
MARGIN = 0.25
#: Registers are equal about as often as the estimate says (the base is near 1); where they are by this much less often
#: than the least estimate asks for, its likelihood need not be maximised.
NEAR_EQUAL = 0.1
#: Members of a bucket in a block, shingles in a strip of the incidence matrix.
BLOCK, STRIP = 512, 8192
#: Pairs whose registers are compared at a time.
AT_ONCE = 65_536
#: Rows of buckets in a task of the search, and of texts in a task of the verification.
DEAL, TEXTS = 4_000, 1_000


def bands_for(percent: int) -> int:
    """Bands that find a pair at the threshold but for one time in a million."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    w = min(width, n)
    out = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : n - w + 1 + k]
    return np.unique(mix64(out))


def multipliers(count: int) -> np.ndarray:
    return mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def registers(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(items), 2048):
        np.minimum(least, (items[a : a + 2048, None] * factors[None, :]).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / math.log(B)), 0, Q + 1).astype(np.uint16)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum.reduce(sketches)


def estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity given how many registers of the first sketch are larger, smaller and equal."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / math.log(B)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(np.broadcast(u, equal).shape), np.minimum(u / v, v / u) * np.ones(np.broadcast(u, equal).shape)
    for _ in range(24):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


SKETCH = "doc_id long, n long, fp binary, bands array<long>, regs binary"


def sketches(docs: DataFrame, width: int, bands: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: size and fingerprint of its set, band keys and registers (null for empty sets). Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(ROWS * bands)
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for batch in slices(batches, "_text", 4 << 20):
            n, fp, regs, keys = [], [], [], []
            for data in blobs(batch.column("_text")):
                items = shingles(data, width)
                n.append(len(items))
                if not len(items):
                    fp.append(None), regs.append(None), keys.append(None)
                    continue
                fp.append(xxh3_128_digest(items.tobytes()))
                r = registers(items, factors)
                k = salt.copy()
                for column in r.reshape(bands, ROWS).T.astype(np.uint64):
                    k = mix64(k * np.uint64(31) + column)
                regs.append(r.tobytes())
                keys.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(regs, pa.binary())],
                [f.split()[0] for f in SKETCH.split(", ")],
            )

    return two_columns(docs, key, text).mapInArrow(run, SKETCH)


def _regs(column: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, count)


def likely(pairs: DataFrame, reps: DataFrame, bands: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimated similarity and set sizes allow a link."""
    m = ROWS * bands
    sides = pairs.join(reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
    sides = sides.join(reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
    sides = sides.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _regs(batch.column("ra"), m), _regs(batch.column("rb"), m)
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            good = estimate((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), na, nb) >= percent / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return sides.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("ta")), "a")
    both = both.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta", 4 << 20):
            good, last, sets = [], None, None
            for b, x, y in zip(batch.column("b").to_pylist(), blobs(batch.column("ta")), blobs(batch.column("tb")), strict=True):
                if b != last:  # the rows of a join come sorted by its key
                    last, sets = b, {}
                if y not in sets:
                    sets = {y: shingles(y, width)}
                p, q = shingles(x, width), sets[y]
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def _blocks(key: np.ndarray, i: np.ndarray, j: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the two sides of every (key, i, j); the same rows twice where a block meets itself."""
    order = np.lexsort((part, j, i, key))
    new = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)))
    for start, end in zip(new, np.append(new[1:], len(order)), strict=True):
        rows = order[start:end]
        if i[rows[0]] == j[rows[0]]:
            yield rows, rows
        else:
            yield rows[part[rows] == i[rows[0]]], rows[part[rows] == j[rows[0]]]


def _search(members: DataFrame, bands: int, percent: int) -> DataFrame:
    """Members of buckets that have a likely partner of another component, by blocks of their bucket."""
    m = ROWS * bands
    least = percent / 100 - MARGIN
    parts = members.withColumn("_parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    parts = parts.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    parts = parts.select("key", "band", F.least("_part", "_other").alias("i"), F.greatest("_part", "_other").alias("j"), "_part", "doc_id", "component", "n", "regs")
    deals = max(1, parts.count() // DEAL)
    parts = parts.withColumn("_deal", F.pmod(F.xxhash64("key", "i", "j"), F.lit(deals)))

    def run(group: pa.Table) -> pa.Table:
        key, i, j, part, ids, comp, band = (group.column(c).to_numpy() for c in ("key", "i", "j", "_part", "doc_id", "component", "band"))
        n = group.column("n").to_numpy().astype(float)
        regs = _regs(group.column("regs").combine_chunks(), m)
        found = np.zeros(len(key), bool)

        def judge(x: np.ndarray, y: np.ndarray) -> None:
            fit = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
            x, y = x[fit], y[fit]
            equal = regs[x] == regs[y]
            close = equal.sum(1) >= m * (least - NEAR_EQUAL)
            close &= equal.reshape(-1, bands, ROWS).all(axis=2).argmax(axis=1) == band[x]  # in the first shared band only
            x, y = x[close], y[close]
            good = estimate((regs[x] > regs[y]).sum(1), (regs[x] < regs[y]).sum(1), (regs[x] == regs[y]).sum(1), n[x], n[y]) >= least
            found[x[good]] = found[y[good]] = True

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = 0
        for left, right in _blocks(key, i, j, part):  # many blocks are tiny, so pairs of several are judged at a time
            strip = max(1, AT_ONCE // max(1, len(right)))
            for a in range(0, len(left), strip):
                some = left[a : a + strip]
                waiting.append((np.repeat(some, len(right)), np.tile(right, len(some))))
                pairs += len(some) * len(right)
                if pairs >= AT_ONCE:
                    judge(*(np.concatenate(side) for side in zip(*waiting, strict=True)))
                    waiting, pairs = [], 0
        if waiting:
            judge(*(np.concatenate(side) for side in zip(*waiting, strict=True)))
        return group.select(["key", "i", "j", "_part", "doc_id", "component"]).filter(pa.array(found))

    return parts.groupBy("_deal").applyInArrow(run, "key long, i int, j int, _part int, doc_id long, component long")


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    names = np.intersect1d(*sides)
    where = []
    for sets, flat in zip((left, right), sides, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
        known = names[at] == flat if len(names) else np.zeros(len(flat), bool)
        order = np.argsort(at[known], kind="stable")
        where.append((row[known][order], at[known][order]))
    for a in range(0, len(names), STRIP):
        strips = []
        for (row, at), sets in zip(where, (left, right), strict=True):
            low, high = np.searchsorted(at, [a, a + STRIP])
            strip = np.zeros((len(sets), min(STRIP, len(names) - a)), np.float32)
            strip[row[low:high], at[low:high] - a] = 1
            strips.append(strip)
        out += strips[0] @ strips[1].T  # whole numbers far below 2^24
    return out


def _verified_blocks(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components within the blocks: each linked member with the smallest member that it reaches there."""
    deals = max(1, rows.count() // TEXTS)
    both = rows.join(texts.select(F.col("_id").alias("doc_id"), "_text"), "doc_id").withColumn("_deal", F.pmod(F.xxhash64("key", "i", "j"), F.lit(deals)))

    def run(group: pa.Table) -> pa.Table:
        key, i, j, part, ids, comp = (group.column(c).to_numpy() for c in ("key", "i", "j", "_part", "doc_id", "component"))
        texts = group.column("_text").combine_chunks().cast(pa.binary())
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for left, right in _blocks(key, i, j, part):
            rows = np.unique(np.concatenate([left, right]))
            sets = {r: shingles(texts[r].as_py(), width) for r in rows.tolist()}
            one, two = [sets[r] for r in left.tolist()], [sets[r] for r in right.tolist()]
            common = common_shingles(one, two).astype(np.int64)
            sizes = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None, :]
            linked = (100 * common >= percent * (sizes - common)) & (common > 0) & (comp[left][:, None] != comp[right][None, :])
            x, y = np.nonzero(linked)
            x, y = np.searchsorted(rows, left[x]), np.searchsorted(rows, right[y])
            reached = least_reached(ids[rows], x, y)
            some = np.flatnonzero(reached != ids[rows])
            out.append((ids[rows][some], reached[some]))
        a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.groupBy("_deal").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable) and kept."""
    bands = bands_for(percent)
    sketch = written(sketches(docs, width, bands, key, text), "sketches")
    known = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    reps = written(known.join(classes.withColumnRenamed("rep", "doc_id"), ["fp", "doc_id"]).dropDuplicates(["fp", "doc_id"]).select("doc_id", "n", "bands", "regs"), "class-sketches")

    buckets = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    leaders = written(buckets.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("_max"), F.count(F.lit(1)).alias("size")).where("b <> _max").drop("_max"), "leaders")
    shared = written(buckets.join(leaders, "key").select("key", "band", "size", "doc_id", "b"), "shared-buckets")
    texts = two_columns(docs, key, text).join(shared.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    texts = texts.withColumn("_same", F.xxhash64("_text")).dropDuplicates(["_id", "_same"]).drop("_same")  # repeated rows once
    texts = written(texts, "candidate-texts")

    pairs = shared.where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    links = written(verified(likely(pairs, reps, bands, percent), texts, width, percent), "star-links")
    found = written(components(links), "components")

    labelled = shared.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = written(labelled.drop("b"), "labelled-buckets")
    mixed = written(labelled.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("key"), "mixed")
    members = labelled.join(mixed, "key").join(reps.select("doc_id", "n", "regs"), "doc_id")
    rest = written(_verified_blocks(written(_search(members, bands, percent), "likely-members"), texts, width, percent), "block-links")
    if not rest.isEmpty():
        found = written(components(links.unionByName(rest)), "components")

    of_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = written(of_class.select("fp", F.coalesce("component", "rep").alias("component")), "class-components")
    out = sketch.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(of_class, "fp", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for those linked, directly or over others, to a document with a smaller id."""
    row = free_name(docs, "_row")
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, F.col("doc_id").cast("long")).join(written(gone, "dropped"), row, "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * hits >= 85 * (p.n + q.n - hits)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, e.y FROM r JOIN e ON r.reached = e.x),
m AS (SELECT node, min(reached) AS least FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id, coalesce(least, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""


@query("op9_near_duplicates", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)

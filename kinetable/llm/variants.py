"""Spelling variant grouping: words one edit apart, found by PartEnum signatures over their letters.

1. Words are counted: runs of letters of whole texts, one in 97 of which (by hash) loses a letter, pre-aggregated per task.
2. A word is the set of its (letter, how many equal letters before it in sorted order): a binary vector.  One inserted,
   deleted or replaced letter changes it in one or two places.  The places are dealt into ``GROUPS`` groups, and for each way
   to leave two groups out a word gets the exact hash of the rest: two words within distance two agree in one of them.
3. An edit leaves the first two or the last two letters alone (words have five at least), so each signature comes twice, with
   the first two and with the last two letters.  The signatures are the keys of the equi-join: rows are dealt and sorted by
   them, and each run of equal ones is compared pair by pair inside the task.  Only verified pairs leave it.
4. A run of more than ``LARGE`` words is not compared but handed on: its words get a signature for each word that a deletion
   leaves, and are dealt by those.  Such a group has at most one word for each letter and place, and is compared as before.

Words, not texts, are exchanged, and a word's near words are counted and reduced before they are brought together.  Forms
at least double the count with every step, so the chains to the roots are short; they are followed by pointer jumping.

Edge cases: null and empty texts have no words; a null id is hashed as an empty one; repeated rows count as often as they
occur; equal counts go to the smaller word; words without near words have n_near 0; very long words are compared letter by
letter; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from .common import blobs, mix64, query, slices, table, written
from .packing import runs

#: Groups of places, two of which are left out; words of a run that are compared directly; rows worked on at a time.
GROUPS, LARGE, BLOCK = 4, 4096, 1 << 17
#: Distinct words held before a task gives out its counts; bytes of text at a time; letters compared in numpy.
HELD, PIECE, WIDE = 200_000, 1 << 20, 32
#: Shortest word, least number of occurrences, one in so many runs loses a letter, count of a form against its word's.
SHORTEST, LEAST, ODD, TIMES = 5, 3, 97, 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: [A-Za-zÀ-ÿ]+ in lower-cased UTF-8
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Letters from frequent to rare, dealt to the groups in turn.
USUAL = "etaoinsrhldcumfpgwybvkxjqz"
RANK = np.full(256, 26, np.int64)
RANK[[ord(c) for c in USUAL]] = np.arange(26)
RANK[192:] = 26 + np.arange(64)
LEFT_OUT = list(itertools.combinations(range(GROUPS), 2))
COUNTED, SIGNED, PAIRED = "word string, n long", "sig long, word string, n long", "sig long, word string, n long, other string, other_n long"


def altered(run: bytes, h: int) -> bytes:
    """The run without its letter number h."""
    letters = run.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        some = [(w, n) for w, n in counts.items() if len(w) >= SHORTEST and len(w.decode()) >= SHORTEST]
        counts.clear()
        return pa.record_batch({"word": pa.array([w for w, _ in some], pa.binary()).cast(pa.string()), "n": pa.array([n for _, n in some], pa.int64())})

    for batch in slices(batches, "_text", PIECE):
        ids = ["" if i is None else str(i) for i in batch.column("_id").to_pylist()]
        for i, text in zip(ids, blobs(batch.column("_text")), strict=True):
            start = zlib.crc32(f"{i}:".encode())
            for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
                if len(run) >= SHORTEST:
                    h = zlib.crc32(run, start)
                    counts[run if h % ODD else altered(run, h)] += n
            if len(counts) >= HELD:
                yield out()
    yield out()


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words with ``LEAST`` occurrences or more."""
    base = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return base.mapInArrow(count_words, COUNTED).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte a letter, filled up with zeros; and the lengths."""
    n = np.array([len(w) for w in words], np.int64)
    width = int(n.max(initial=1))
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width), n


def signatures(words: list[bytes]) -> np.ndarray:
    """Signatures of words (one byte a letter, of similar length): a row for each word."""
    table_, n = letters(words)
    inside = np.arange(table_.shape[1]) < n[:, None]
    sorted_ = np.sort(np.where(inside, table_, 255), axis=1).astype(np.int64)
    place = np.broadcast_to(np.arange(sorted_.shape[1]), sorted_.shape)
    fresh = np.ones(sorted_.shape, bool)
    fresh[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    before = place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
    group = (RANK[sorted_] + 3 * before) % GROUPS
    hashed = mix64((sorted_ << 32 | before).astype(np.uint64) + np.uint64(1))
    inside = np.arange(sorted_.shape[1]) < n[:, None]
    sums = [np.where(inside & (group == g), hashed, np.uint64(0)).sum(axis=1) for g in range(GROUPS)]
    at = np.arange(len(words))
    first = table_[:, 0].astype(np.uint64) << np.uint64(8) | table_[:, 1]
    last = table_[at, n - 2].astype(np.uint64) << np.uint64(8) | table_[at, n - 1]
    out = []
    for side, ends in enumerate((first, last)):
        for k, gone in enumerate(LEFT_OUT):
            h = mix64(ends + np.uint64((2 * k + side) << 16 | 1 << 40))
            for g in range(GROUPS):
                if g not in gone:
                    h = mix64(h + sums[g])
            out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def by_width(words: list[bytes]) -> Iterator[list[int]]:
    """Places of the words whose lengths have the same number of bits."""
    bits = np.array([len(w).bit_length() for w in words])
    for b in np.unique(bits).tolist():
        yield np.flatnonzero(bits == b).tolist()


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "word", PIECE):
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        for at in by_width(words):
            sigs = signatures([words[k] for k in at])
            rows = pa.array(np.repeat(np.array(at), sigs.shape[1]))
            yield pa.record_batch({"sig": pa.array(sigs.reshape(-1)), "word": batch.column("word").take(rows), "n": batch.column("n").take(rows)})


def sign_deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A signature for the word, and for each word that the deletion of a letter leaves."""
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            w = word.encode("latin-1")
            sigs = {xxh3_64_intdigest(w), *(xxh3_64_intdigest(w[:k] + w[k + 1 :]) for k in range(len(w)))}
            signed = np.array(sorted(sigs), np.uint64).view(np.int64)
            yield pa.record_batch({"sig": pa.array(signed), "word": pa.array([word] * len(sigs)), "n": pa.array([n] * len(sigs), pa.int64())})


def one_edit(a: bytes, b: bytes) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    k = next((k for k in range(len(short)) if short[k] != long[k]), len(short))
    return short[k + 1 :] == long[k + 1 :] if len(a) == len(b) else short[k:] == long[k + 1 :]


class Block:
    """Rows sorted by signature, whose runs of equal ones are whole."""

    def __init__(self, sig: np.ndarray, words: list[bytes]) -> None:
        self.sig, self.words = sig, words
        self.n = np.array([len(w) for w in words], np.int64)
        self.plain = self.n <= WIDE
        self.left = np.array([w if len(w) <= WIDE else b"" for w in words], f"S{WIDE}").view(np.uint8).reshape(len(words), WIDE)
        self.right = np.array([w[::-1] if len(w) <= WIDE else b"" for w in words], f"S{WIDE}").view(np.uint8).reshape(len(words), WIDE)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words of the pairs are one edit apart: what they share at both ends makes up all but one letter."""
        out = np.zeros(len(i), bool)
        close = np.abs(self.n[i] - self.n[j]) <= 1
        for p in np.flatnonzero(close & ~(self.plain[i] & self.plain[j])).tolist():
            out[p] = one_edit(self.words[i[p]], self.words[j[p]])
        p = np.flatnonzero(close & self.plain[i] & self.plain[j])
        i, j = i[p], j[p]
        differ = self.left[i] != self.left[j]
        some = differ.any(axis=1)
        shared = differ.argmax(axis=1) + (self.right[i] != self.right[j]).argmax(axis=1)
        out[p] = some & (shared >= np.maximum(self.n[i], self.n[j]) - 1)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Near pairs of each run, by their distance in it."""
        at, found = np.arange(len(self.words)), []
        for step in itertools.count(1):
            at = at[at + step < len(self.sig)]
            at = at[self.sig[at] == self.sig[at + step]]
            if not len(at):
                break
            for k in range(0, len(at), BLOCK):
                i = at[k : k + BLOCK]
                i = i[self.near(i, i + step)]
                found.append(np.stack([i, i + step]))
        return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def verified(batches: Iterator[pa.RecordBatch], large: int | None) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of rows sorted by signature; rows of runs of more than ``large`` words as they are, without a partner.

    Holds what is left of the last run and a batch; of a large run, ``large`` words and a batch.
    """
    sig, words, n, dropping = np.zeros(0, np.int64), [], [], None

    def handed_on(at: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64())
        return pa.record_batch({"sig": pa.array(sig[at]), "word": pa.array([words[k].decode("latin-1") for k in at.tolist()], pa.string()), "n": pa.array([n[k] for k in at.tolist()], pa.int64()), "other": none[0], "other_n": none[1]})

    def worked_off(end: int) -> Iterator[pa.RecordBatch]:
        first = runs(sig[:end])
        size = np.diff(np.append(first, end))
        big = np.repeat((size > large) if large else np.zeros(len(size), bool), size) | (sig[:end] == dropping if dropping is not None else False)
        if big.any():
            yield handed_on(np.flatnonzero(big))
        rest = np.flatnonzero(~big)
        if len(rest):
            some = [words[k] for k in rest.tolist()]
            i, j = Block(sig[rest], some).pairs()
            i, j = np.append(i, j).tolist(), np.append(j, i).tolist()
            m = [n[k] for k in rest.tolist()]
            yield pa.record_batch({
                "sig": pa.array([0] * len(i), pa.int64()), "word": pa.array([some[k].decode("latin-1") for k in i], pa.string()), "n": pa.array([m[k] for k in i], pa.int64()),
                "other": pa.array([some[k].decode("latin-1") for k in j], pa.string()), "other_n": pa.array([m[k] for k in j], pa.int64()),
            })

    for batch in batches:
        sig = np.append(sig, batch.column("sig").to_numpy())
        words += [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        n += batch.column("n").to_pylist()
        last = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
        if large and len(sig) - last > large:
            dropping = sig[-1]
        end = len(sig) if dropping is not None and len(sig) and sig[-1] == dropping else last
        if end >= BLOCK or end == len(sig):
            yield from worked_off(end)
            sig, words, n = sig[end:], words[end:], n[end:]
    yield from worked_off(len(sig))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all pairs of words one edit apart, both ways."""

    def joined(signed: DataFrame, large: int | None) -> DataFrame:
        dealt = signed.repartition("sig").sortWithinPartitions("sig")
        return dealt.mapInArrow(lambda batches: verified(batches, large), PAIRED)

    first = written(joined(words.mapInArrow(sign, SIGNED), LARGE), "variant-pairs")
    handed = first.where("other IS NULL").select("word", "n").distinct()
    second = joined(handed.mapInArrow(sign_deletions, SIGNED), None)
    return first.unionByName(second).where("other IS NOT NULL").select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word of each chain. Every round halves the chains and is written."""
    now = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = written(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "variant-roots")
        if step.where("moved").isEmpty():
            return now
        now = step.drop("moved")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written(words_of(docs, key, text), "variant-words")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    good = F.col("n_near").isNotNull() & (-F.col("best.m") >= TIMES * F.col("n"))
    out = words.join(near, "word", "left").select(
        "word", F.when(good, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, -F.col("best.m")).alias("form_n"),
    )
    out = written(out, "variant-forms")
    return out.join(roots(out.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS c FROM r GROUP BY ALL HAVING length(w) >= 5),
b AS (SELECT w, c, flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS bytes FROM d),
h AS (SELECT w, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda s, y: xor(s >> 8, tab[CAST(1 + (xor(s, y) & 255) AS BIGINT)])), 4294967295) AS h FROM b, tab),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v),
m AS (SELECT word, n, k, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS hole, substr(word, 1, k - 1) || substr(word, k + 1) AS less FROM x),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM m a JOIN m b ON a.hole = b.hole AND a.word <> b.word
      UNION SELECT m.word, v.word, v.n FROM m JOIN v ON m.less = v.word
      UNION SELECT v.word, m.word, m.n FROM m JOIN v ON m.less = v.word),
g AS (SELECT word, count(*) AS n_near, min({'m': -m, 'form': other}) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.form END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM v LEFT JOIN g USING (word)),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
l AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN l USING (word)
"""


@query("op13_variants", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))

import math
from collections import defaultdict

import pytest

from kinetable.llm import contexttree as C

UPPER = {c: c + 32 for c in range(65, 91)}


def split(text):
    text = (text or "").translate(UPPER)
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def stream(text):
    return b"\n" * C.DEPTH + " ".join(split(text)).encode() + b"\n"


def brute(rows, held):
    """Plain recursion over dictionaries of nodes."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def steps(data):
        for p in range(C.DEPTH, len(data)):
            place = 1
            for bit in range(8):
                yield data, p, place, data[p] >> (7 - bit) & 1
                place = place * 2 + (data[p] >> (7 - bit) & 1)

    for i, t in rows:
        if not held(i):
            for data, p, place, bit in steps(stream(t)):
                for d in range(C.DEPTH + 1):
                    counts[data[p - d : p], place][bit] += 1
                    if d:
                        children[data[p - d + 1 : p], place].add(data[p - d : p])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    memo = {}

    def weighted(context, place):
        if (context, place) not in memo:
            own = kt(*counts.get((context, place), (0, 0)))
            if len(context) < C.DEPTH:
                rest = sum(weighted(c, place) for c in children.get((context, place), ()))
                top = max(own, rest)
                own = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(rest - top))
            memo[context, place] = own
        return memo[context, place]

    def one(data, p, place, d=0):
        context = data[p - d : p]
        a, b = counts.get((context, place), (0, 0))
        here = (b + 0.5) / (a + b + 1)
        if d == C.DEPTH:
            return here
        stop = math.exp(math.log(0.5) + kt(a, b) - weighted(context, place))
        return stop * here + (1 - stop) * one(data, p, place, d + 1)

    unigrams = defaultdict(int)
    for i, t in rows:
        if not held(i):
            for w in [*split(t), "\n"]:
                unigrams[w] += 1
    n, v = sum(unigrams.values()), len(unigrams)
    out = []
    for i, t in rows:
        log = sum(math.log10(q if bit else 1 - q) for data, p, place, bit in steps(stream(t)) for q in [one(data, p, place)])
        words = [*split(t), "\n"]
        base = sum(math.log10((unigrams.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((str(i), held(i), len(words), sum(w in unigrams for w in words), n, base, log))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect())


def same(have, want):
    assert [r[:5] for r in have] == [r[:5] for r in want]
    for a, b in zip(have, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-6)


ODD = [(62, None), (63, ""), (64, " \n\t "), (65, "one"), (66, "ONE two"), (None, "one two three"), (None, None), (67, "é🙂 x"), (70, "\x00 nul % \r\n"), (71, "one two"), (71, "one two")]


@pytest.mark.parametrize("chunk,bucket", [(16 << 20, 8 << 20), (700, 500)])
def test_matches_brute_force(spark, texts, monkeypatch, chunk, bucket):
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "BUCKET", bucket)
    monkeypatch.setattr(C, "SLICE", 100)
    rows = texts[:12] + ODD
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _text string, _held int").repartition(3)
    same(result(C.score(docs, held_out="doc_id % 5 = 0")), brute(rows, lambda i: i is not None and i % 5 == 0))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc de"), (2, None)], "doc_id long, text string")
    rows = result(C.score(docs, held_out="true"))
    assert [r[:5] for r in rows] == [("1", True, 3, 0, 0), ("2", True, 1, 0, 0)]
    assert rows[0][5:] == pytest.approx((0.0, -7 * 8 * math.log10(2))) and rows[1][5:] == pytest.approx((0.0, -8 * math.log10(2)))


def test_empty(empty):
    assert C.score(empty).count() == 0


def test_all_rows_whatever_their_texts(docs, texts):
    """Very long texts, copies and repeated rows: one row each, and copies score alike."""
    rows = result(C.score(docs, held_out="doc_id = 60"))
    assert [r[0] for r in rows] == sorted(str(i) for i, _ in texts)
    copies = [r[5:] for r in rows if r[0] in ("60", "61")]
    assert len(copies) == 3 and all(c == pytest.approx(copies[0]) for c in copies)


def test_learnt_texts_cost_less(spark):
    text = "a rather particular sentence about herons and canals " * 3
    docs = spark.createDataFrame([(k, text) for k in range(8)] + [(10, text), (11, text[::-1])], "doc_id long, text string")
    bits = {r.doc_id: r.bits_per_byte for r in C.score(docs, held_out="doc_id >= 10").collect()}
    assert bits[10] < 0.5 < 2 < bits[11]


def test_estimates():
    import numpy as np

    n = np.array([0, 1, 2, 4094, 4095, 4096, 4097, 10**6, 10**9])
    want = [math.lgamma(k + 0.5) - math.lgamma(0.5) for k in n.tolist()]
    assert C.log_half_rising(n).tolist() == pytest.approx(want, rel=1e-12)
    assert C.log_factorial(n).tolist() == pytest.approx([math.lgamma(k + 1) for k in n.tolist()], rel=1e-12)

import hashlib
import random
import re

import pytest
from samples import sentence

from kinetable.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = set()
    for i, t in items:
        w = words(t)
        windows |= {(i, tuple(w[a : a + 10])) for a in range(max(1, len(w) - 9)) if w}
    out = []
    for d, t in docs:
        w, hit, told = words(t), set(), set()
        for i, x in windows:
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit.update(range(a, a + len(x)))
                    told |= {str(i)} if i is not None else set()
        out.append((str(d), len(w), len(hit), len(told), hashlib.sha256(",".join(sorted(told)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(texts):
    body = dict(texts)
    a, b = body[3].split(), body[41].split()
    return [(1, " ".join(a[2:16])), (2, "ONE two"), (3, None), (4, " -- "), (5, " ".join(b[14:30]).upper()), (5, " ".join(a[:10])), (None, " ".join(a[5:15])), (7, "the " * 12), (10, " ".join(b[20:33]))]


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@pytest.mark.parametrize("block,segment,vocabulary", [(4_000_000, 2 << 20, 4_000_000), (20, 500, 3)])
def test_matches_brute_force(spark, docs, texts, items, monkeypatch, block, segment, vocabulary):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    monkeypatch.setattr(D, "SEGMENT", segment)
    monkeypatch.setattr(D, "VOCABULARY", vocabulary)
    extra = [(200, "the " * 40), (201, "x one TWO y")]
    some = [(i, t) for i, t in texts if t is None or len(t) < 10_000] + extra
    if block == 20:  # blocks of items come together by id, so ids must tell documents apart
        some = [(k, t) for k, (_, t) in enumerate(some)]
    table = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.summarised(D.decontaminate(table, bench))) == brute(some, items)


def test_proximity(spark):
    rng = random.Random(5)
    w = sentence(rng, 14).split()
    w = [f"{x}{k}" for k, x in enumerate(w)]
    near = w[:4] + ["inserted"] + w[4:10]
    far = [x for k in range(10) for x in (w[k], "gap", "gap", "gap")]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far)), (4, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(w[:10]))], "item_id long, text string")
    got = {r.doc_id: sorted(set(zip(r["items"], r.exact))) for r in D.decontaminate(docs, bench, near=True).collect()}
    assert got == {1: [(9, True)], 2: [(9, False)], 3: [], 4: []}


def test_blocks_keep_rows_with_null_and_repeated_ids(spark, texts, items, monkeypatch):
    some = [(i, t) for i, t in texts if t is None or len(t) < 10_000] + [(200, "the " * 40), (200, "x one TWO y"), (200, "clean"), (None, "the " * 12), (None, "clean too"), (None, None)]
    table = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 20):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        assert rows(D.summarised(D.decontaminate(table, bench))) == brute(some, items)


def test_proximity_without_the_rarest_words(spark):
    w = [f"word{k}" for k in range(19)]
    filler = " ".join(w[:9] + w[10:]) + " "
    docs = [
        (1, " ".join([*w[:9], "changed", *w[10:]])),  # no ten unchanged words in a row; word9 occurs nowhere
        (2, " ".join(w[:4])), (3, filler.replace("word12 ", "").replace("word3 ", "") * 3), (4, "lead in " + " ".join(w[2:9]) + " lead out"),
        (None, " ".join(w[2:9] + ["x"] + w[10:12])), (None, "clean"), (5, "end " + " ".join(w[:8])), (6, " ".join(w[11:])),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")
    got = D.summarised(D.decontaminate(table, bench, near=True), near=True).collect()

    def close(text):
        have = text.split()
        for a in range(10):
            for s in range(-10, len(have)):
                if sum(any(w[a + k] == have[p] for p in range(max(0, s + k - 2), min(len(have), s + k + 3))) for k in range(10)) >= 8:
                    return "9"
        return ""

    want = [(d, False, close(t)) for d, t in docs]
    assert sorted(map(str, ((r.doc_id, r.contaminated, r.near_items) for r in got))) == sorted(map(str, want))
    assert [n for _, _, n in want] == ["9", "", "9", "", "9", "", "9", "9"] and all((r.n_near > 0) == (r.near_items != "") and r.n_near <= r.n_words for r in got)


def test_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.summarised(D.decontaminate(empty, bench)).count() == 0
    got = D.summarised(D.decontaminate(docs, bench.limit(0))).collect()
    assert len(got) == docs.count() and not any(r.contaminated for r in got)


def test_drop(spark, docs, texts, items):
    bench = spark.createDataFrame(items[:1], "item_id long, text string")
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    gone = {r[0] for r in brute(texts, items[:1]) if r[-1]}
    assert gone and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in texts if str(i) not in gone)

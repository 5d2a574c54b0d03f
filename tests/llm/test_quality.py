import random
import zlib

import numpy as np
from samples import sentence

from kinetable.llm import quality as Q


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(900):
        good = rng.random() < 0.7
        words = sentence(rng, rng.randint(5, 80)).split()
        text = " ".join(words) if good else rng.choice([" ".join(w + "&&&" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words for _ in range(4))])
        rows.append((k, text))
        labels.append((k, int(good)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    weights = Q.train(docs, known)
    assert (weights == Q.train(docs.repartition(7), known)).all()
    truth = dict(labels)
    got = [(r.score >= Q.ACCEPT, truth[r.doc_id]) for r in Q.scores(docs, weights).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) > 150 and np.mean([a == b for a, b in got]) > 0.96
    assert Q.keep_good(docs, weights).count() < len(rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    rng = random.Random(3)
    rows = [(k, sentence(rng, 20)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    two = spark.createDataFrame([(k, 1 - k % 2 if zlib.crc32(str(k).encode()) % 4 == 2 else k % 2) for k in range(200)], "doc_id long, quality int")
    assert (Q.train(docs, one) == Q.train(docs, two)).all()


def test_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 7), (5, 1)], "doc_id long, quality int")
    weights = Q.train(docs, labels)
    got = Q.scores(docs, weights).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert Q.scores(empty, weights).count() == 0
    nothing = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.scores(docs, nothing).collect()} == {0.5}
    assert Q.keep_good(docs, weights).schema == docs.schema


def test_outlines_of_long_words_are_read_to_their_end():
    words = ["aB1-" * 20 + end for end in ("xxx", "XXX", "x-9", "")]
    assert len({Q._hash_outline(w.encode().translate(Q.OUTLINE)) for w in words}) == 4
    assert not any(len(w) > 64 for w in Q._outlines)

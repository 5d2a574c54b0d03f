import re

from kinetable.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

ROWS = [
    (1, "Released under the MIT License."), (2, "under the mit license under\nthe-MIT-license"), (3, "Licensed under the Apache License, Version 2.0."),
    (4, "CC BY-NC 4.0"), (5, "CC BY-NC-SA and cc by sa"), (6, "This work is licensed under the GNU General Public License, version 3."), (7, "the GNU general public licence version 3"),
    (8, "under mit the license"), (9, None), (10, ""), (11, "MIT"), (12, "under the MIT license " * 3000), (13, "Permission is hereby granted, free of charge, to any person"),
    (14, "ÉCC by nc"), (15, "cc by ncÉ"), (None, "cc by nc"), (4, "CC BY-NC 4.0"), (16, "gnu general public license version 3 gnu general public license version 2"),
]


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(k, label) for label, phrase in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    labels = {label for _, label in places}
    for t in L.TEMPLATES:
        key = t.key.split()
        if any(words[k : k + len(key)] == key for k in range(len(words))):
            labels.add(t.label)
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels))


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in ROWS], "doc_id long, text string, _words string, n_words string").repartition(3)
    got = L.summarised(L.scan_licenses(docs)).collect()
    have = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in got)
    assert have == sorted(str((i, *brute(t))) for i, t in ROWS)
    score = {r.doc_id: r.score for r in got}
    assert all(0 <= r.score <= 1 for r in got) and score[1] == 1.0 and score[9] == score[10] == 0.0
    assert 0.5 < score[13] < 1.0  # the key phrase and a part of what follows it


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = L.summarised(L.scan_licenses(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_tables(docs, empty):
    assert L.summarised(L.scan_licenses(docs)).count() == docs.count()
    assert L.summarised(L.scan_licenses(empty)).count() == 0

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinetable.llm import variants as V

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: set() for w in n}
    for a, b in itertools.combinations(n, 2):
        if V.one_edit(a.encode("latin-1"), b.encode("latin-1")):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, str(form[w]), root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def slow_edit(a, b):
    """By trying every edit."""
    alphabet = {*a, *b}
    edits = {a[:k] + a[k + 1 :] for k in range(len(a))}
    edits |= {a[:k] + bytes([c]) + a[k + e :] for k in range(len(a) + 1) for c in alphabet for e in (0, 1)}
    return a != b and b in edits


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = ["heron", "canal", "boats", "rather", "particular", "éclair", "mississippi", "aaaaaa", "naïveté", "STRASSE"]
    out = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(base[: 1 + rng.randrange(10)])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice("abeé"), w[k] * 2]) + w[k + 1 :]
            words.append(w)
        out.append((i, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    long = "q" * 40 + "z"
    out += [(900 + k, f"{'x' * 50_000} {long} {long[1:]} {long}s") for k in range(4)]
    return out + [(None, "heron Heron canal"), (None, None), (400, ""), (401, None), (402, "abc 123 é ×÷×÷×"), (7, "heron"), (7, "heron")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(3)


@pytest.mark.parametrize("large,held,block", [(4096, 200_000, 1 << 17), (3, 50, 64)])
def test_matches_brute_force(spark, rows, monkeypatch, large, held, block):
    """With small limits, large runs go by their deletions."""
    for name, value in (("LARGE", large), ("HELD", held), ("BLOCK", block)):
        monkeypatch.setattr(V, name, value)
    got = V.variants(table(spark, rows)).collect()
    assert sorted((r.word, str(r.form), r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == brute(rows)


def test_signatures_of_all_single_edits():
    """Every word one edit away shares a signature."""
    rng = random.Random(9)
    for _ in range(200):
        a = bytes(rng.choice(b"abcde\xe9") for _ in range(rng.randint(5, 12)))
        k, c = rng.randrange(len(a) + 1), bytes([rng.choice(b"abxyz")])
        b = rng.choice([a[:k] + c + a[k:], a[: k - 1] + c + a[k:] if k else c + a[1:]])
        sigs = [set(V.signatures([w])[0].tolist()) for w in (a, b)]
        assert sigs[0] & sigs[1]


def test_one_edit():
    words = [bytes(w) for n in (3, 4, 5) for w in itertools.product(b"ab", repeat=n)]
    block = V.Block(np.zeros(len(words), np.int64), words)
    i, j = (np.array(x) for x in zip(*itertools.product(range(len(words)), repeat=2), strict=True))
    want = [slow_edit(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert block.near(i, j).tolist() == want
    assert [V.one_edit(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)] == want


def test_chains_of_forms(spark):
    chain = [f"w{k}" for k in range(12)]
    forms = spark.createDataFrame(list(itertools.pairwise(chain)), "word string, form string")
    assert {(r.word, r.root) for r in V.roots(forms).collect()} == {(w, "w11") for w in chain[:-1]}


def test_empty(empty):
    assert V.variants(empty).count() == 0

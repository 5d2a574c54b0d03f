import random
from itertools import combinations

import numpy as np
import pytest
from samples import sentence

from kinetable.llm import neardup as N
from kinetable.llm.components import components


def sets(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[a : a + width]) for a in range(max(1, len(w) - width + 1))} if w else set()


def closed(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed = changed or least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def brute(rows, width, percent):
    own = {}
    for d, t in rows:
        if d is not None:
            own.setdefault(d, sets(t, width))
    links = [(a, b) for a, b in combinations(own, 2) if own[a] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
    least = closed(own, links)
    return sorted((str(d), len(sets(t, width)), str(least.get(d)), d is None or least[d] == d) for d, t in rows)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_matches_brute_force(docs, texts, width, percent):
    got = N.near_duplicates(docs, width, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(texts, width, percent)


def test_chains_within_buckets_are_whole(spark, monkeypatch):
    """Each text is near the next, few are near the smallest; blocks of members are small."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "DEAL", 50)
    monkeypatch.setattr(N, "TEXTS", 20)
    rng = random.Random(7)
    w = [f"{x}{k}" for k, x in enumerate(sentence(rng, 100).split())]
    rows = []
    for k in range(40):
        w = w[:]
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append(((k * 17) % 41, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = N.near_duplicates(docs, 3, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, 3, 85)


def test_drop_keeps_the_smallest(spark, docs, empty, texts):
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    gone = {r[0] for r in brute(texts, 5, 80) if not r[3]}
    assert gone and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in texts if str(i) not in gone)
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0


def test_estimates_and_merges():
    rng = np.random.default_rng(1)
    factors = N.multipliers(400)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 2**63, 300).astype(np.uint64)])
    ra, rb = N.registers(a, factors), N.registers(b, factors)
    told = N.estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([(ra == rb).sum()]), np.array([3000.0]), np.array([2700.0]))[0]
    assert abs(told - 2400 / 3300) < 0.06
    assert (N.merge(ra, rb) == N.registers(np.union1d(a, b), factors)).all()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 340)] + [(7, 7)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closed({x for l in links for x in l}, links)
    assert got == {n: c for n, c in want.items() if any(n in l and l[0] != l[1] for l in links)}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_shingles():
    rng = random.Random(2)
    left, right = [[np.array(sorted(rng.sample(range(60), rng.randint(0, 30))), np.uint64) for _ in range(n)] for n in (7, 5)]
    assert N.common_shingles(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert N.common_shingles([], right).shape == (0, 5)


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    """Two near documents, fifty rows each: one pair is verified, and every row is answered."""
    from samples import sentence

    words = sentence(random.Random(2), 60).split()
    rows = [(1, " ".join(words))] * 50 + [(2, " ".join([*words[:-1], "other"]))] * 50
    sizes, write = {}, N.written

    def noted(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(N, "written", noted)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True)] * 50 + [(2, 1, False)] * 50
    assert sizes["class-sketches"] == 2 and sizes["candidate-texts"] == 2 and sizes["star-links"] == 1

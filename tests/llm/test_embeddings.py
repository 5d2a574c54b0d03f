import math
import random

import numpy as np
import pytest

from kinetable.llm import embeddings as E


def brute(rows, cosine):
    good = [k for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    links = [(a, b) for a in good for b in good if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    least = {k: rows[k][0] for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed = changed or least[a] != m or least[b] != m
            least[a] = least[b] = m
    count = [0] * len(rows)
    for a, _ in links:
        count[a] += 1
    return sorted((str(i), count[k], str(least[k]), i is None or least[k] == i) for k, (i, _, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for label in (1, 2):
        centres = rng.normal(size=(6, 16))
        for k in range(150):
            v = centres[k % 6] + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.4])
            out.append((label * 1000 + k, v.tolist(), label))
    v = out[5][1]
    out += [(9, v, 1), (9000 + 1, v, 1), (9002, [2 * x for x in v], 1), (9003, v, 2), (9004, v, None), (None, v, 1), (9005, None, 1), (9006, [], 1), (9007, [0.0] * 16, 1)]
    out += [(9008, [float("nan")] * 16, 1), (9009, [float("inf")] + [0.0] * 15, 1), (9010, [None] + [1.0] * 15, 1), (9011, v[:8], 1), (9012, v[:8], 1)]
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize("interval,leaf", [(1024, 128), (32, 8)])
def test_matches_brute_force(spark, rows, monkeypatch, interval, leaf):
    monkeypatch.setattr(E, "INTERVAL", interval)
    monkeypatch.setattr(E, "LEAF", leaf)
    monkeypatch.setattr(E, "SORTED", 64)
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, label int, rep string, links string").repartition(3)
    got = E.near_duplicate_vectors(table).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows, 0.98)


def test_repeated_rows_and_empty_table(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicate_vectors(table).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert E.near_duplicate_vectors(table.limit(0)).count() == 0


def test_distant_intervals_are_skipped(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (np.eye(4)[k % 4] + rng.normal(size=4) * 0.01).tolist(), 1) for k in range(200)]
    valid = E.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "label", "embedding")
    classes = valid.selectExpr("_label", "fp", "_id AS rep", "1L AS n", "vec").cache()
    axes = E.principal_axes(classes, 4)
    cut = E.intervals(classes, axes, 0.2, 200 * E.SORTED // 20).cache()
    n = cut.count()
    assert E.near_intervals(cut, 0.2).count() < n * (n + 1) / 4


def answers(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicate_vectors(table).collect())


def test_one_id_with_two_vectors(spark):
    """Each row has the links of its own vector."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1)]
    assert answers(spark, rows) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1)]
    assert answers(spark, rows) == [(2, 1, 2, True), (3, 1, 3, True), (5, 1, 2, False), (5, 1, 3, False)]


@pytest.mark.parametrize("scale", [1e200, 1e300, 1e-200, 1e-300])
def test_norms_outside_the_doubles(spark, scale):
    rows = [(1, [scale, 0.0], 1), (2, [scale, scale * 0.01], 1), (3, [0.0, scale], 1), (4, [1.0, 0.0], 1), (None, [scale, 0.0], 1), (6, [scale, 0.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in E.near_duplicate_vectors(table).collect())
    assert got == [("1", 2, "1"), ("2", 2, "1"), ("3", 0, "3"), ("4", 2, "1"), ("6", 0, "6"), ("None", 0, "None")]

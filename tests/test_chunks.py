"""Two-level scans against plain Python over random sessions."""

import random

import pytest
from pyspark.sql import functions as F

from kinetable.operators import chunks as C


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for s in range(12):
        n = rng.choice([1, 2, 7, 8, 30, 61])
        for i in range(n):
            rows.append((s, i, rng.choice([1, -1, 0, 1, None]), rng.choice([None, rng.randint(0, 50)]), rng.random() * 100))
    return rows, spark.createDataFrame(rows, "session_id bigint, frame_idx bigint, step int, v int, f double").cache()


def by_session(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_running_values(data, size):
    rows, df = data
    k = ["session_id"]
    last = C.running_last(df, k, "frame_idx", {"o": F.col("v")}, size)
    total = C.running_sum(df, k, "frame_idx", {"o": F.col("v")}, size)
    top = C.running_max_before(df, k, "frame_idx", F.col("v"), "o", size)
    got = [{(r.session_id, r.frame_idx): r.o for r in d.collect()} for d in (last, total, top)]
    for s, rs in by_session(rows).items():
        l, t, m = None, 0, None
        for r in rs:
            assert got[2][(s, r[1])] == m
            if r[3] is not None:
                l, t, m = r[3], t + r[3], r[3] if m is None else max(m, r[3])
            assert got[0][(s, r[1])] == l
            assert got[1][(s, r[1])] == t


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_walk(data, size):
    rows, df = data
    full = C.reflected_walk(df.na.fill({"step": -1}), ["session_id"], "frame_idx", F.col("step"), "o", size)
    walk = {(r.session_id, r.frame_idx): r.o for r in full.collect()}
    walked = C.walk_in_chunk(C.chunked(df, "frame_idx", size), ["session_id", "_chunk"], "frame_idx", F.col("step"))
    first = {r.session_id: r.first_hit for r in C.walk_first_passage(walked, ["session_id"], "frame_idx", 3).collect()}
    for s, rs in by_session(rows).items():
        c = d = 0
        hit = None
        for r in rs:
            c = max(0, c + (r[2] if r[2] is not None else -1))
            assert walk[(s, r[1])] == c
            d = 0 if r[2] is None else max(0, d + r[2])
            if d >= 3 and hit is None:
                hit = r[1]
        assert first[s] == hit


@pytest.mark.parametrize("size", [1, 4, 50])
def test_halo_windows(data, size):
    rows, df = data
    wide = C.halo(df, "frame_idx", 2, 3, size)
    w = C.by_chunk(["session_id"], "frame_idx").rowsBetween(-2, 3)
    got = {(r.session_id, r.frame_idx): r.o for r in C.core(wide.withColumn("o", F.sum("v").over(w))).collect()}
    assert len(got) == len(rows)
    for s, rs in by_session(rows).items():
        for i, r in enumerate(rs):
            near = [x[3] for x in rs[max(0, i - 2): i + 4] if x[3] is not None]
            assert got[(s, r[1])] == (sum(near) if near else None)


def test_dense_index_and_percentiles(data):
    rows, df = data
    ranked = C.dense_index(df, ["session_id"], ["f"], F.floor(F.col("f") / 10), "o")
    got = {(r.session_id, r.f): r.o for r in ranked.collect()}
    pct = {r.session_id: r for r in C.exact_percentiles(df, ["session_id"], "f", {"m": 0.5, "p": 0.95}, 7.0).collect()}
    import numpy as np

    for s, rs in by_session(rows).items():
        values = sorted(r[4] for r in rs)
        assert [got[(s, v)] for v in values] == list(range(len(values)))
        assert pct[s].m == pytest.approx(np.percentile(values, 50))
        assert pct[s].p == pytest.approx(np.percentile(values, 95))

"""The releasing latch against a plain loop, over several levels of chunks."""

import random

import pytest
from pyspark.sql import functions as F

from kinetable.operators import automata, tracking


def loop(rows, hold, clear):
    out, key = {}, None
    for s, i, c, u in rows:
        if s != key:
            key, latched, since, straight = s, False, 0, 0
        if c:
            latched, since = True, i
        if latched and clear:
            straight = straight + 1 if u else 0
            if straight >= clear:
                latched, straight = False, 0
        if latched and hold and i - since >= hold:
            latched, straight = False, 0
        out[s, i] = latched
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for s in range(6):
        busy, straight = rng.random() * 0.3, rng.random()
        i = 0
        for _ in range(rng.choice([1, 30, 150])):
            i += rng.choice([1, 1, 1, 3]) if s == 5 else 1
            out.append((s, i, rng.random() < busy, rng.random() < straight or None))
    return out


@pytest.mark.parametrize("hold,clear", [(0, 0), (8, 0), (0, 3), (5, 3), (40, 7), (1, 1)])
def test_against_a_loop(spark, rows, small_chunks, hold, clear):
    df = spark.createDataFrame(rows, "session_id long, frame_idx long, c boolean, u boolean").repartition(3)
    got = tracking.latch_with_release(df, F.col("c"), F.col("u"), hold, clear)
    assert {(r.session_id, r.frame_idx): r.latched for r in got.collect()} == loop(rows, hold, clear)


def test_no_python_and_no_whole_sessions(spark, rows):
    df = spark.createDataFrame(rows, "session_id long, frame_idx long, c boolean, u boolean")
    plan = tracking.latch_with_release(df.where("true"), F.col("c"), F.col("u"), 0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_composition(spark, small_chunks):
    """A counter modulo 5 over 300 rows."""
    df = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") % 3).cast("int").alias("code"))
    table = automata.transition_table(lambda s, c: (s * 2 + c) % 5, 3, 5)
    got = {r.i: r.state for r in automata.run(df, ["k"], "i", F.col("code"), table).collect()}
    s = 0
    for i in range(300):
        s = (s * 2 + i % 3) % 5
        assert got[i] == s

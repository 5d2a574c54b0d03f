"""Sessions with their own rates: equal rates give what the one-rate operators give; every rate is that of its own."""

import pytest
from pyspark.sql import functions as F

from kinetable.operators import causal, detect, geometry, paced
from kinetable.plans import fixtures as fx

from conftest import SF


@pytest.fixture(scope="module")
def keypoints(spark):
    return fx.keypoints(spark, SF).where("session_id < 5").cache()


def rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def sessions(spark, keypoints, fps, height):
    return keypoints.select("session_id").distinct().withColumns({"fps": F.lit(fps), "frame_height": F.lit(height)})


@pytest.mark.parametrize("fps,height", [(10.0, 480), (24.0, 720)])
def test_equal_rates(spark, keypoints, small_chunks, fps, height):
    own = sessions(spark, keypoints, fps, height)
    columns = ["session_id", "frame_idx", "state", "first_fallen_frame", "score", "hip_speed", "torso_angle"]
    assert rows(paced.fall_states(keypoints, own), *columns) == rows(detect.fall_states(keypoints, fps, height), *columns)
    live = ["session_id", "frame_idx", "state", "fall_latched", "calibrating", "score", "low_hip"]
    assert rows(paced.causal_fall_states(keypoints, own), *live) == rows(causal.causal_fall_states(geometry.frame_geometry(keypoints), fps, height), *live)


def test_every_session_at_its_own_rate(spark, keypoints):
    """One table with two rates gives the rows of two calls."""
    a, b = keypoints.where("session_id < 2"), keypoints.where("session_id >= 2")
    own = sessions(spark, a, 5.0, 480).unionByName(sessions(spark, b, 30.0, 900))
    columns = ["session_id", "predicted", "first_falling_frame", "first_fallen_frame", "first_fallen_seconds", "max_score"]
    want = rows(detect.session_summary(a, 5.0, 480), *columns) + rows(detect.session_summary(b, 30.0, 900), *columns)
    assert rows(paced.session_summary(keypoints, own), *columns) == sorted(want)


def test_rates_must_be_positive(spark, keypoints):
    with pytest.raises(Exception, match="fps must be positive"):
        paced.session_summary(keypoints, sessions(spark, keypoints, 0.0, 480)).collect()


def test_sessions_without_a_rate_drop_out(spark, keypoints):
    own = sessions(spark, keypoints.where("session_id = 1"), 10.0, 480)
    assert {r.session_id for r in paced.session_summary(keypoints, own).collect()} == {1}


def test_first_passage_from_any_carry(spark, small_chunks):
    """Walks over chunks of seven rows against the plain loop, with levels of their own."""
    import random

    from kinetable.operators import chunks

    rng, steps = random.Random(4), []
    for s in range(40):
        steps += [(s, i, rng.choice([1, 1, 1, 0, -1, None]) if s % 3 else rng.choice([1, 0]), 1 + s % 9) for i in range(60)]
    df = spark.createDataFrame(steps, "session_id long, frame_idx long, step int, level int")
    walked = chunks.walk_in_chunk(chunks.chunked(df, "frame_idx"), ["session_id", "_chunk"], "frame_idx", F.col("step"))
    got = {r.session_id: r.first_hit for r in paced.walk_first_passage(walked, ["session_id"], "frame_idx", "level", F.lit(False)).collect()}
    want = {}
    for s, i, step, level in steps:
        c = 0 if i == 0 else c
        c = 0 if step is None else max(0, c + step)
        if s not in want or want[s] is None:
            want[s] = i if c >= level else None
    assert got == want

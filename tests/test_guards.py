"""Cases that once lost rows or stopped a job."""

import pytest
from pyspark.sql import functions as F

from kinetable.operators import candidates, chat, chunks, detect, geometry, multiview, people, sequences
from kinetable.streaming import detector, flows


def limbs(spark, rows):
    return spark.createDataFrame(
        rows, "session_id long, frame_idx long, pair_idx int, cand_a int, ax double, ay double, a_score double, cand_b int, bx double, by double, b_score double"
    )


def test_limbs_without_field_or_length_are_scored(spark):
    ends = limbs(spark, [(1, 0, 0, 0, 1.0, 1.0, 0.5, 0, 1.0, 1.0, 0.5), (1, 0, 0, 0, 1.0, 1.0, 0.5, 1, 6.0, 1.0, 0.5), (2, 0, 0, 0, 1.0, 1.0, 0.5, 1, 6.0, 1.0, 0.5)])
    field = spark.createDataFrame([(2, 0, 0, 1, x, 1.0, 0.0) for x in range(8)], "session_id long, frame_idx long, pair_idx int, cy int, cx int, fx double, fy double")
    got = {(r.session_id, r.cand_b): r.score for r in candidates.limb_scores(ends, field, 8, 8, 0.05, 0.4, 0.05).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 0.0, (2, 1): 1.0}


def test_pairs_stay_within_their_session(spark):
    rows = [(s, 0, p, 0, 1.0, 1.0, 0.5) for s in (1, 2) for p in (0, 1)]
    cand = spark.createDataFrame(rows, "session_id long, frame_idx long, part int, cand_idx int, x double, y double, score double")
    assert candidates.candidate_pairs(cand, [(0, 1)]).count() == 2


def test_system_turn_and_broken_conversations(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "bot", "x"), (2, 2, "user", "q"), (2, 3, "assistant", "a")],
        "conv_id long, turn long, role string, text string",
    )
    got = chat.expand_assistant_turns(chat.prepend_system(turns, "be brief")).collect()
    assert [(r.conv_id, r.turn, [t.role for t in r.prompt]) for r in got] == [(1, 1, ["system", "user"])]
    assert {r.error for r in chat.validate_turns(turns).collect()} == {"unknown role"}


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_halo_reaches_negative_positions(spark, size):
    df = spark.createDataFrame([(1, i) for i in range(-2, 5)], "k long, i long")
    wide = chunks.halo(df, "i", 1, 1, size)
    got = chunks.core(wide.withColumn("n", F.count("*").over(chunks.by_chunk(["k"], "i").rowsBetween(-1, 1)))).collect()
    assert {r.i: r.n for r in got} == {-2: 2, -1: 3, 0: 3, 1: 3, 2: 3, 3: 3, 4: 2}


def test_divisions_without_divisor(spark):
    one = spark.createDataFrame([(1, 0, 5.0, 0.0)], "session_id long, frame_idx long, v double, t double")
    assert sequences.latency_summary(one, "v", F.col("t")).first().average_fps is None
    spot = spark.createDataFrame([("unit", 1, 10, 0.5, 0.5)], "m string, w int, h int, x double, y double")
    assert people.scale_keypoints(spot, "m", "w", "h", 1.0, 1.0).first().x is None
    obs = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 1.0, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "px double, py double, pz double, x double, y double, p array<double>")
    assert multiview.with_reprojection_error(obs).first().error is None
    kp = spark.createDataFrame([(1, 0, j, 1.0, 1.0, 0.0) for j in range(15)], "session_id long, frame_idx long, joint int, x double, y double, c double")
    assert geometry.frame_geometry(kp, 0.0).first().head_x is None


def test_sweep_uses_the_windows_of_each_config(spark):
    from test_scenarios import figure, keypoints

    kp = keypoints(spark, figure(60, 20, 10))
    configs = [detect.RuleConfig(), detect.RuleConfig(evidence_window_seconds=3.0, confirmation_seconds=1.5), detect.RuleConfig(evidence_window_seconds=0.3, confirmation_seconds=2.5)]
    swept = {r.config_id: r.first_fallen_frame for r in detect.threshold_sweep(kp, 10.0, 480, configs).collect()}
    alone = {i: detect.session_summary(kp, 10.0, 480, c).first().first_fallen_frame for i, c in enumerate(configs)}
    assert swept == alone and swept[0] != swept[1] and swept[2] is None


SIGNAL = "session_id long, frame_idx long, seconds double, detected boolean, head_y double, hip_y double, torso_angle double, bbox_aspect double, body_height double, control string"


def drained(stream, tmp_path):
    return flows.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()


def test_short_sessions_and_late_frames(spark, tmp_path):
    rows = [(1, i, i / 5.0, True, 100.0, 200.0, 5.0, 0.4, 220.0, None) for i in range(6)] + [(1, 5, None, None, None, None, None, None, None, "end")]
    rows += [(2, i, i / 5.0, True, 100.0, 200.0, 5.0, 0.4, 220.0, None) for i in (*range(16), 3)]
    spark.createDataFrame(rows, SIGNAL).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SIGNAL).parquet(str(tmp_path / "in"))
    got = drained(detector.detect_stream(stream, detector.LiveConfig(fps=None)), tmp_path)
    assert sorted(r.frame_idx for r in got if r.session_id == 1) == list(range(6))
    assert [r.frame_idx for r in got if r.state == detector.LATE] == [3] and len(got) == 6 + 17


def test_reorder_gives_out_the_tail(spark, tmp_path):
    schema = "session_id long, frame_idx long, view_idx int, n_views int, payload string"
    rows = [(1, i, 0, 1, f"p{i}") for i in range(20) if i != 5][::-1] + [(1, None, None, None, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = sorted(drained(flows.reorder_stream(stream), tmp_path), key=lambda r: r.seq)
    assert [r.frame_idx for r in got] == [i for i in range(20) if i != 5] and not any(r.late for r in got)

"""Falls on a synthetic figure, offline and live."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import detect, multiview, people, sequences
from kinetable.operators.geometry import frame_geometry
from kinetable.streaming.rule import Frame, LiveRule, Memory, forced, released


def figure(count, start, length):
    rows = []
    for i in range(count):
        p = min(max((i - start) / length, 0.0), 1.0)
        hip = (320.0, 260 + 130 * p)
        sh = (320 + 100 * p, 150 + 210 * p)
        j = {0: (320 + 130 * p, 80 + 290 * p), 1: sh, 2: (sh[0] - 20, sh[1]), 5: (sh[0] + 20, sh[1]), 8: hip,
             9: (hip[0] - 20, hip[1]), 12: (hip[0] + 20, hip[1])}
        for a, dx in ((10, -20), (13, 20)):
            j[a] = (hip[0] + dx, hip[1] + 70 * (1 - p) + 10)
        for a, dx in ((11, -20), (14, 20)):
            j[a] = (hip[0] + dx, hip[1] + 140 * (1 - p) + 15)
        rows += [(1, i, k, float(x), float(y), 1.0) for k, (x, y) in j.items()]
    return rows


def keypoints(spark, rows):
    return spark.createDataFrame(rows, "session_id bigint, frame_idx bigint, joint int, x double, y double, c double")


@pytest.fixture(scope="module")
def signals(spark):
    def of(rows):
        g = frame_geometry(keypoints(spark, rows)).orderBy("frame_idx").collect()
        return [(r.detected, {"head_y": r.head_y, "hip_y": r.hip_y, "torso_angle": r.torso_angle, "bbox_aspect": r.bbox_aspect}, r.body_height) for r in g]

    return of


def test_offline_fall(spark):
    got = detect.fall_states(keypoints(spark, figure(60, 20, 10)), 10.0, 480).orderBy("frame_idx").collect()
    assert got[-1].state == "FALLEN" and got[0].state == "NORMAL"


def test_static_pose_has_no_speed(spark):
    from kinetable.operators.timeseries import extract_features

    f = extract_features(keypoints(spark, figure(40, 1000, 10)), 10.0, 480)
    assert f.agg(F.max(F.abs("hip_speed"))).first()[0] == 0.0


def test_latch_and_frozen_baseline(signals):
    rule, m, base = LiveRule(15.0, 480), Memory(), None
    for i, f in enumerate(signals(figure(600, 75, 15))):
        m, out = rule.step(m, Frame(*f))
        if i == 40:
            base = (m.body, m.hip)
    assert out["state"] == "FALLEN" and m.first_alarm < 150
    assert (m.body, m.hip) == base
    m = released(m)
    assert not m.alarmed and m.state == "NORMAL"


@pytest.mark.parametrize("hold,count,latched", [(5.0, 200, False), (0.0, 600, True)])
def test_hold(signals, hold, count, latched):
    rule, m = LiveRule(10.0, 480, fall_hold_seconds=hold), Memory()
    for f in signals(figure(count, 50, 10)):
        m, _ = rule.step(m, Frame(*f))
    assert m.alarmed is latched


def test_forced_alarm_and_dropout(signals):
    frames = signals(figure(60, 1000, 10))
    rule, m = LiveRule(10.0, 480), Memory()
    for f in frames[:40]:
        m, _ = rule.step(m, Frame(*f))
    nothing = Frame(False, dict.fromkeys(frames[0][1]), None)
    m, out = rule.step(m, nothing)
    assert out["state"] == "NORMAL"
    for _ in range(10):
        m, out = rule.step(m, nothing)
    assert out["state"] == "UNKNOWN"
    assert rule.step(forced(m), Frame(*frames[41]))[1]["state"] == "FALLEN"


def test_no_alarm_while_calibrating(signals):
    rule, m = LiveRule(10.0, 480), Memory()
    for f in signals(figure(19, 5, 5)):
        m, out = rule.step(m, Frame(*f))
        assert not out["fall_latched"]


def test_memory_survives_and_stays_small(signals):
    rule, one, two = LiveRule(10.0, 480), Memory(), Memory()
    for f in signals(figure(120, 50, 10)):
        one, a = rule.step(one, Frame(*f))
        two, b = rule.step(Memory.load(two.dump()), Frame(*f))
        assert a == b
    assert len(two.dump()) < 3000


def test_stream_in_two_batches(spark, tmp_path):
    from kinetable.operators.timeseries import SERIES
    from kinetable.streaming import detector, flows

    g = frame_geometry(keypoints(spark, figure(80, 40, 10))).select(
        "session_id", "frame_idx", (F.col("frame_idx") / 10.0).alias("seconds"), "detected", *SERIES, "body_height",
        F.lit(None).cast("string").alias("control"),
    )
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    live = detector.LiveConfig(fps=10.0)
    for lo, hi in ((0, 45), (45, 80)):
        g.where(f"frame_idx >= {lo} AND frame_idx < {hi}").write.mode("append").parquet(src)
        got = flows.run_to_table(detector.detect_stream(spark.readStream.schema(g.schema).parquet(src), live), out, ck)
    rows = got.orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == list(range(80)) and rows[-1].state == "FALLEN"


def test_triangulation_finds_the_points(spark):
    from kinetable.plans import views as V
    from conftest import SF

    truth = V.world(spark, SF).select("session_id", "frame_idx", "joint", *[F.col(c).alias("t" + c) for c in ("px", "py", "pz")])
    obs = V.observations(spark, SF)
    u, v = multiview.projected(obs)
    clean = obs.withColumns({"x": u, "y": v}).drop("px", "py", "pz", "c")
    solved = multiview.triangulate(clean, 3).join(truth, ["session_id", "frame_idx", "joint"])
    worst = solved.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col("t" + c)) for c in ("px", "py", "pz")]))).first()[0]
    assert worst < 1e-6


def test_worst_view_is_dropped(spark):
    from kinetable.plans import views as V

    cams = {r.camera_id: np.array(r.p).reshape(3, 4) for r in V.cameras(spark).collect()}
    point = np.array([0.3, -0.4, 0.2, 1.0])
    rows = []
    for k, p in cams.items():
        x = p @ point
        rows.append((1, 0, 0, k, float(x[0] / x[2] + (90 if k == 2 else 0)), float(x[1] / x[2]), p.ravel().tolist()))
    obs = spark.createDataFrame(rows, "session_id bigint, frame_idx bigint, joint int, camera_id int, x double, y double, p array<double>")
    got = multiview.drop_worst_view(multiview.triangulate(obs, 3), multiview.max_acceptable_error(640, 480)).first()
    assert got.dropped_view == 2 and abs(got.px - 0.3) < 1e-6


def test_people_are_assembled(spark):
    from kinetable.operators.candidates import assemble_people

    rows = [
        (1, 0, 0, 0, 0, 0.9, 0.8, 0.9), (1, 0, 1, 0, 0, 0.9, 0.7, 0.8),  # person 0: parts 0-1-2
        (1, 0, 0, 1, 1, 0.8, 0.5, 0.7),                                  # person 1: parts 0-1
        (1, 0, 1, 1, 0, 0.1, 0.5, 0.1),                                  # would join both: part sets overlap
    ]
    limbs = spark.createDataFrame(rows, "session_id bigint, frame_idx bigint, pair_idx int, cand_a int, cand_b int, a_score double, b_score double, score double")
    got = assemble_people(limbs, [(0, 1), (1, 2)]).orderBy("person_idx", "part").collect()
    assert [(r.person_idx, r.part, r.cand_idx) for r in got] == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 0, 1), (1, 1, 1)]


def test_identities_follow_people(spark):
    from kinetable.operators.tracking import link_track_ids

    rows = []
    for f in range(40):
        if 15 <= f < 30:
            continue
        for person, x in ((0, 100 + 2 * f), (1, 400 - 2 * f)):
            slot = person if f % 2 else 1 - person
            rows += [(1, f, slot, j, float(x + j), 50.0 + j, 0.9) for j in range(3)]
    df = spark.createDataFrame(rows, "session_id bigint, frame_idx bigint, person_idx int, joint int, x double, y double, c double")
    got = {(r.frame_idx, r.person_idx): r.track_id for r in link_track_ids(df, 3, 17.3).collect()}
    for f in range(1, 15):
        assert got[(f, 0 if f % 2 else 1)] == got[(0, 1)]
    assert {got[(f, s)] for f in range(30, 40) for s in (0, 1)} == {2, 3}


def test_errors():
    with pytest.raises(ValueError):
        people.frame_range(None, 5, 2, 1)
    with pytest.raises(ValueError):
        sequences.resample_sequence(None, ["x"], 0)
    with pytest.raises(ValueError):
        LiveRule(0.0, 480)


def test_confusion_counts(spark):
    from kinetable.operators.metrics import with_rates

    got = with_rates(spark.createDataFrame([(878, 428, 390, 41, 19)], "samples int, tp int, tn int, fp int, fn int")).first()
    assert round(got.f1, 4) == 0.9345


def test_per_file_people_json(spark, tmp_path):
    import json

    from kinetable.sources.readers import read_people_json

    for i in range(3):
        people_ = [{"pose_keypoints_2d": [float(i)] * 6}] if i else [{"pose_keypoints_2d": [1.0]}]
        (tmp_path / f"{i:012d}_keypoints.json").write_text(json.dumps({"version": 1.3, "people": people_}, indent=1))
    got = read_people_json(spark, str(tmp_path), 2).orderBy("name", "joint").collect()
    assert [(r.name, r.joint, r.x, r.c) for r in got] == [
        (f"{i:012d}_keypoints", j, float(i) if i else None, float(i)) for i in range(3) for j in (0, 1)
    ]


def test_camera_file(spark, tmp_path):
    from kinetable.sources.readers import read_camera_xml

    m = lambda tag, data: f"<{tag} type_id='m'>\n<rows>3</rows>\n<cols>4</cols>\n<dt>d</dt>\n<data>\n {data}</data></{tag}>"
    (tmp_path / "17.xml").write_text(
        "<?xml version=\"1.0\"?>\n<!-- units: meters -->\n<opencv_storage>\n" + m("CameraMatrix", "1. 0. 0. 2.\n 0. 1. 0. 0.\n 0. 0. 1. 0.")
        + m("Intrinsics", "8.0e+02 0. 6. 0. 8.0e+02 5. 0. 0. 1.") + m("Distortion", "0. 0. 0. 0. 0. 0. 0. 0.") + "\n</opencv_storage>\n"
    )
    got = read_camera_xml(spark, str(tmp_path)).first()
    assert got.serial == "17" and got.p[:4] == [800.0, 0.0, 6.0, 1600.0]

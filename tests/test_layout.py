"""What is broadcast, what is dealt out again, and how results are written."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from kinetable.plans import catalog
from kinetable.sources import writers as Wr


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=977 * i), i % 60, ("click", "view", "error")[i % 3], i % 50 / 2.0, None) for i in range(12000)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def plan_lines(df):
    return [(len(line) - len(line.lstrip(" :+-")), line) for line in df._jdf.queryExecution().executedPlan().toString().splitlines()]


@pytest.mark.parametrize("name", [
    "augment_sequences", "backproject_affine", "blend_tracked", "drop_worst_view", "drop_worst_view_disturbed", "filter_people", "iterative_outlier_removal",
    "merge_best_keypoint", "min_views", "multi_view_mask", "part_lookup", "person_distance", "reject_outlier_points", "people_to_keypoints", "reprojection_rms",
])
def test_keypoints_are_not_broadcast(spark, events, name):
    lines = plan_lines(catalog.queries()[name](spark, events))
    for k, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for d, text in lines[k + 1:]:
                if d <= depth:
                    break
                below.append(text)
            assert not (any("FileScan" in t for t in below) and any("joint#" in t for t in below)), line


@pytest.mark.parametrize("name", ["backproject_affine", "filter_people", "min_views", "part_lookup", "people_to_keypoints"])
def test_positions_are_not_broadcast(spark, events, name):
    """A session may have as many time slices as frames: their counts are joined by sorting."""
    lines = plan_lines(catalog.queries()[name](spark, events))
    for k, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [text for d, text in lines[k + 1:k + 2] if d > depth]
            assert not any("_bucket" in text or "_shift" in text or "frame_idx" in text for text in below), line
    assert any("SortMergeJoin" in line and "_bucket" in line for _, line in lines)


@pytest.mark.parametrize("name", ["remap_skeleton", "select_person_conf"])
def test_people_stay_with_their_frame(spark, events, name):
    """What is grouped by person or frame is dealt out once, as frames."""
    lines = plan_lines(catalog.queries()[name](spark, events))
    assert not [line for _, line in lines if "Exchange hashpartitioning" in line and "person_idx#" in line]


def test_export_gathers_only_its_own_joints(spark):
    people = spark.range(135).select(
        F.lit(1).cast("bigint").alias("session_id"), F.lit(2).cast("bigint").alias("frame_idx"), F.lit(0).alias("person_idx"), F.col("id").cast("int").alias("joint"),
        (F.col("id") * 1.0).alias("x"), F.lit(3.0).alias("y"), F.when(F.col("id") < 25, 1.0).otherwise(0.5).alias("c"),
    )
    row = Wr.person_maps(people, Wr.EXPORT_135["foot"]).first()
    assert sorted(row["kps"]) == list(range(19, 25)) and row["score"] == pytest.approx((25 + 110 * 0.5) / 135)
    out = Wr.coco_results(people, F.col("frame_idx"), "foot", Wr.EXPORT_135).first()
    assert out["keypoints"] == [v for j in range(19, 25) for v in (float(j), 3.0, 1.0)] and out["score"] == row["score"]


def test_results_can_be_packed(spark, tmp_path):
    rows = spark.range(5).select("id", F.array(F.lit(1.5), F.lit(2.0)).alias("keypoints"))
    Wr.write_json(rows, f"{tmp_path}/packed", "gzip")
    assert all(f.endswith(".json.gz") for f in os.listdir(f"{tmp_path}/packed") if f.startswith("part-"))
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(f"{tmp_path}/packed").collect())) == sorted(map(tuple, rows.collect()))


def test_a_folder_per_key_has_few_files(spark, tmp_path):
    """Rows of a key come together, however many tasks hold some of them."""
    rows = spark.range(0, 4000, 1, 16).select((F.col("id") % 40).alias("session_id"), F.col("id").cast("string").alias("value"))
    Wr.write_people_json(rows, f"{tmp_path}/people")
    Wr.write_detections(rows, f"{tmp_path}/detections")
    for path in (f"{tmp_path}/people", f"{tmp_path}/detections"):
        files = [f for folder, _, names in os.walk(path) for f in names if f.startswith("part-")]
        assert len(files) == len([d for d in os.listdir(path) if d.startswith("session_id=")]) == 40
    assert spark.read.text(f"{tmp_path}/people").count() == 4000


def test_documents_are_made_without_exchange(spark, events):
    """Frames are dealt out once; their people, their numbers and the texts stay there."""
    from kinetable.plans.documents import full_documents

    lines = plan_lines(full_documents(spark, events))
    assert not [line for _, line in lines if "Exchange hashpartitioning" in line and ("person_idx#" in line or "name#" in line)]


def test_keys_gathered_at_once(spark):
    from kinetable.sources import documents as D

    rows = spark.createDataFrame([("f", 0, 0, 1.0, 2.0, 3.0, 0.5), ("f", 0, 2, 4.0, 5.0, 6.0, 0.7), ("f", 1, 0, 7.0, 8.0, 9.0, 0.9)], "name string, person_idx int, part int, x double, y double, z double, c double")
    out = D.flat_keys(rows, ["name", "person_idx"], {"all": (F.lit(True), 0, 3, 3), "hand": (F.expr("part = 2"), 2, 1, 4)}).orderBy("person_idx").collect()
    assert [r["all"] for r in out] == [[1.0, 2.0, 0.5, 0.0, 0.0, 0.0, 4.0, 5.0, 0.7], [7.0, 8.0, 0.9] + [0.0] * 6]
    assert [r["hand"] for r in out] == [[4.0, 5.0, 6.0, 0.7], None]


def test_resampling_sends_no_row_a_step(spark, events):
    """Rows meet one row per (key, chunk); a step's two frames are added up before they are sent."""
    lines = plan_lines(catalog.queries()["resample_sequence"](spark, events))
    assert not [line for _, line in lines if "Exchange hashpartitioning" in line and "frame_idx#" in line]
    assert [line for _, line in lines if "ShuffledHashJoin" in line and "_chunk#" in line and "BuildRight" in line]


@pytest.mark.parametrize("n, last", [(1, 0), (1, 5), (2, 1), (4, 0), (5, 3), (16, 6), (16, 66), (40, 7)])
def test_resampled_steps(spark, small_chunks, n, last):
    from kinetable.operators.sequences import resample_sequence

    rows = spark.createDataFrame([(1, i, float(i * i)) for i in range(last + 1)] + [(None, 0, 1.0), (2, None, 1.0)], "session_id bigint, frame_idx bigint, v double")
    want = []
    for k in range(n):
        at = k * last / max(n - 1, 1)
        a, w = int(at), at - int(at)
        want.append(a * a * (1 - w) + min(a + 1, last) ** 2 * w)
    got = resample_sequence(rows, ["v"], n).orderBy("step").collect()
    assert [(r["session_id"], r["step"]) for r in got] == [(1, k) for k in range(n)] and [r["v"] for r in got] == pytest.approx(want)


def test_live_rows_are_plain_records():
    import numpy as np
    import pandas as pd

    from kinetable.streaming import detector

    batch = pd.DataFrame({"frame_idx": [2.0, np.nan, 1.0, 2.0], "control": ["force", "end", None, None], "hip_y": [np.nan, np.nan, 3.0, 4.0]})
    rows = sorted(detector.records(batch), key=detector.place)
    assert rows == [
        {"frame_idx": 1.0, "control": None, "hip_y": 3.0}, {"frame_idx": 2.0, "control": None, "hip_y": 4.0},
        {"frame_idx": 2.0, "control": "force", "hip_y": None}, {"frame_idx": None, "control": "end", "hip_y": None},
    ]
    assert list(detector.table([]).columns) == detector.COLUMNS and detector.table([{"frame_idx": 3}])["state"].isna().all()


def test_people_are_gathered_without_lists_of_joints(spark):
    """Lists of joints are sorted, and spilled, row by row; running maxima are hashed."""
    rows = [(1, f, 0, j, 1.0 * j, 2.0, 0.5) for f in range(3) for j in range(135) if f < 2 or j > 90]
    people = spark.createDataFrame([*rows, (1, 0, 0, None, 9.0, 9.0, 0.5)], "session_id bigint, frame_idx bigint, person_idx int, joint int, x double, y double, c double")
    for variant in ("foot", "face", "hand21", "hand42"):
        out = Wr.coco_results(people, F.col("frame_idx"), variant, Wr.EXPORT_135)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
        order = Wr.EXPORT_135[variant]
        found = {r["frame_idx"]: r["keypoints"] for r in out.collect()}
        want = [v for j in order for v in ((1.0 * j, 2.0, 1.0) if j > 90 else (-1.0, -1.0, 0.0))]
        assert found[0] == found[1] == [v for j in order for v in (1.0 * j, 2.0, 1.0)]
        assert found.get(2) == (want if any(j > 90 for j in order) else None)


def test_repeated_exported_joints_are_refused(spark):
    """As a map of joints refuses them; joints that are not exported may be repeated."""
    row = lambda joint: (1, 0, 0, joint, 1.0, 2.0, 0.5)
    schema = "session_id bigint, frame_idx bigint, person_idx int, joint int, x double, y double, c double"
    twice = lambda joint: Wr.coco_results(spark.createDataFrame([row(19), row(joint), row(joint)], schema), F.col("frame_idx"), "foot", Wr.EXPORT_135)
    assert len(twice(3).collect()) == 1
    with pytest.raises(Exception, match="repeated"):
        twice(20).collect()

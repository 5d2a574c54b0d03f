"""Physical plans keep what the design promises."""

import re

import pytest
from conftest import SF

import __spark_entry__ as entry
from kinetable.plans import fixtures as fx

QUERIES = entry.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fall_states", "session_summary", "causal_fall_states", "rolling_fps", "empty_runs", "clutch_delta"])
def test_session_windows_run_on_chunks(spark, name):
    text = plan(spark, name)
    assert not re.search(r"Python|Pandas", text)
    # A window over frame_idx has the chunk among its partition columns; the only exception is the
    # baseline, which reads just the opening frames of a session.
    for spec in re.findall(r"windowspecdefinition\(([^()]*frame_idx#\d+L? ASC[^()]*)", text):
        assert "_chunk" in spec or "LessThan(frame_idx,25)" in text


@pytest.mark.parametrize("name", ["person_iou", "track_hand_boxes", "track_pair_scores", "limb_scores", "sliding_clips", "ensemble_search3", "split_counts", "merge_stray_faces"])
def test_no_cross_joins(spark, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "pending_work")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_linestatus,F\)", text)
    assert "ReadSchema: struct<l_orderkey:bigint,l_linestatus:string>" in text


def test_top_people_are_limited_before_the_exchange(spark):
    assert "WindowGroupLimit" in plan(spark, "keep_top_people")


def test_calibration_stream_reads_all_frames(spark):
    got = QUERIES["stream_calibration_fps"](spark, SF).select("session_id", "frame_idx")
    want = fx.frames(spark, SF).select("session_id", "frame_idx")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ["fall_states", "session_summary"])
def test_evidence_is_worked_out_once(spark, name):
    """Both sides of the final join read the written evidence."""
    text = plan(spark, name)
    assert text.count("FileScan parquet") >= 2 and "joint" not in text and text.count("Window [") < 8


def test_roles_are_looked_up_once(spark):
    assert plan(spark, "expand_assistant_turns").count("windowspecdefinition") <= 2

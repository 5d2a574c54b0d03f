"""What reaches the driver doesn't grow with the events: only tables of fixed rows are broadcast, whatever the sizes are reckoned to be."""

import datetime

import pytest

from kinetable.plans import catalog


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Small enough that every table read or counted from it is taken for one to broadcast."""
    folder = str(tmp_path_factory.mktemp("events"))
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=977 * i), i % 60, ("click", "view", "error")[i % 3], i % 50 / 2.0, None) for i in range(12000)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def broadcast(df):
    """The plan below each broadcast."""
    lines = [(len(line) - len(line.lstrip(" :+-")), line) for line in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    for k, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((n for n in range(k + 1, len(lines)) if lines[n][0] <= depth), len(lines))
            yield "\n".join(text for _, text in lines[k + 1:end])


NAMES = [
    "blend_tracked",
    "drop_worst_view",
    "drop_worst_view_disturbed",
    "filter_people",
    "iterative_outlier_removal",
    "merge_best_keypoint",
    "min_views",
    "multi_view_mask",
    "part_lookup",
    "person_distance",
    "reject_outlier_points",
]


@pytest.mark.parametrize("name", NAMES)
def test_only_fixed_tables_are_broadcast(spark, events, name):
    found = list(broadcast(catalog.queries()[name](spark, events)))
    assert found and not [below for below in found if "FileScan" in below or "Exchange" in below]

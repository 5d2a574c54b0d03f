"""Tables of people are joined where their frames lie: no row of a joint is exchanged."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_driver_memory import events  # noqa: F401

from kinetable.operators import tracking as T
from kinetable.plans import catalog, fixtures as fx

NAMES = [
    "blend_tracked",
    "merge_best_keypoint",
    "people_to_keypoints",
    "person_distance",
    "track_pair_scores",
]


@pytest.mark.parametrize("name", NAMES)
def test_joints_are_not_exchanged(spark, events, name):  # noqa: F811
    plan = catalog.queries()[name](spark, events)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"hashpartitioning\([^()]*(person_idx|person_a|person_b|joint|part)#", plan)


def test_dealt_people_are_the_people(spark, events):  # noqa: F811
    for later in (0, 1):
        have = fx.dealt_people(spark, events, later).drop("_deal")
        want = fx.people(spark, events).withColumn("frame_idx", F.col("frame_idx") + later)
        assert have.columns == want.columns and have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()


def test_pairs_by_cells_are_those_of_all_pairs(spark):
    mix = random.Random(7)
    spot = lambda: mix.choice([mix.uniform(-40, 40), 10.0 * mix.randrange(-4, 5)])
    rows = [[(s, f, p, j, spot(), spot(), mix.choice([0.05, 0.5])) for s in range(2) for f in range(4) for p in range(6) for j in range(3)] for _ in range(2)]
    a, b = [spark.createDataFrame(r, "session_id bigint, frame_idx bigint, person_idx int, joint int, x double, y double, c double") for r in rows]
    want = {}
    for s, f, p, j, x, y, c in rows[0]:
        for s2, f2, q, j2, x2, y2, c2 in rows[1]:
            if (s, f, j) == (s2, f2, j2) and min(c, c2) >= 0.1:
                n = want.setdefault((s, f, p, q), [0, 0])
                n[0] += ((x - x2) ** 2 + (y - y2) ** 2) ** 0.5 < 10.0
                n[1] += 1
    want = {k: tuple(n) for k, n in want.items() if n[0] and n[0] / n[1] >= 0.3}
    got = {(r.session_id, r.frame_idx, r.person_a, r.person_b): (r.inliers, r.active) for r in T.track_pair_scores(a, b, 10.0, least=0.3).collect()}
    assert want and got == want

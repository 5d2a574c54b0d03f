"""Points are solved where their frames lie, and again in the row they come in."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_driver_memory import events  # noqa: F401

from kinetable.operators import multiview as V
from kinetable.plans import catalog, views

NAMES = ["drop_worst_view", "drop_worst_view_disturbed", "triangulate", "triangulate_disturbed"]


@pytest.mark.parametrize("name", NAMES)
def test_points_are_neither_exchanged_nor_joined(spark, events, name):  # noqa: F811
    plan = catalog.queries()[name](spark, events)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^()]*joint#", plan) and not re.search(r"Join \[[^\]]*joint#", plan)


def test_the_worst_view_is_the_one_without_which_the_error_is_least(spark):
    mix, rows, want = np.random.default_rng(3), [], {}
    cams = [np.array(views.matrix(c, s)).reshape(3, 4) for c, s in views.ROTATION.values()]

    def solved(seen):
        a = np.concatenate([[x * p[2] - p[0], y * p[2] - p[1]] for x, y, p in seen])
        h = np.linalg.svd(a)[2][-1]
        at = h[:3] / h[3]
        uv = [(p @ [*at, 1])[:2] / (p @ [*at, 1])[2] for _, _, p in seen]
        return at, float(np.mean([np.hypot(u[0] - x, u[1] - y) for u, (x, y, _) in zip(uv, seen, strict=True)]))

    for k in range(40):
        point, n = np.append(mix.uniform(-1, 1, 3), 1), 2 + k % 3
        seen = [(*((p @ point)[:2] / (p @ point)[2]), p) for p in cams[:n]]
        if k % 2:
            seen[k % n] = (seen[k % n][0] + 60, *seen[k % n][1:])
        rows += [(k % 5 or None, k, 0, c, float(x), float(y), p.ravel().tolist()) for c, (x, y, p) in enumerate(seen)]
        at, error = solved(seen)
        tries = [(*solved(seen[:i] + seen[i + 1:])[::-1], i) for i in range(n)] if k % 5 and n >= 4 and error > 5 else []
        less = min(((e, i, at) for e, at, i in tries if e < 0.9 * error), default=(error, None, at))
        want[k] = (less[1], n - (less[1] is not None), *less[2], less[0])
    obs = spark.createDataFrame(rows, "session_id bigint, frame_idx bigint, joint int, camera_id int, x double, y double, p array<double>")
    out = V.drop_worst_view(V.triangulate(obs, 2), 10.0).select("frame_idx", "dropped_view", F.size("views").alias("n"), "px", "py", "pz", "error").collect()
    got = {r[0]: tuple(r)[1:] for r in out}
    assert got.keys() == want.keys() and any(v[0] is not None for v in want.values())
    for k, v in want.items():
        assert got[k][:2] == v[:2] and np.allclose(got[k][2:], v[2:], atol=1e-6)


def test_a_point_that_is_no_number_is_null(spark):
    p = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]  # both cameras stand in one place and look along the same ray
    obs = spark.createDataFrame([(1, 1, 1, k, 0.0, 0.0, p) for k in range(2)], "session_id bigint, frame_idx bigint, joint int, camera_id int, x double, y double, p array<double>")
    row = V.triangulate(obs, 2).first()
    assert not any(v is not None and v != v for v in (row.px, row.py, row.pz, row.error))

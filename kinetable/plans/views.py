"""Multi-view queries: four cameras look inwards at the figures of every frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import metrics, multiview as V
from . import fixtures as fx
from .registry import cte, query, rounded

ROTATION = {0: (1.0, 0.0), 1: (0.0, 1.0), 2: (-1.0, 0.0), 3: (0.0, -1.0)}  # cos, sin of the yaw


def matrix(c: float, s: float) -> list[float]:
    """Intrinsics (focal 500, centre 320, 240) times the pose: yaw about y, ten units in front."""
    return [
        500 * c - 320 * s, 0.0, 500 * s + 320 * c, 3200.0, -240 * s, 500.0, 240 * c, 2400.0, -s, 0.0, c, 10.0,
    ]


def cameras(spark: SparkSession) -> DataFrame:
    rows = [(i, 500.0, 640, 480, 90 * i, [v + 0.0 for v in matrix(*ROTATION[i])]) for i in range(4)]
    return spark.createDataFrame(rows, "camera_id int, focal double, width int, height int, yaw int, p array<double>")


def world(spark, sf) -> DataFrame:
    """3-D joints of every frame, which stay together in a task with what cameras see of them."""
    kp = fx._figure(fx.by_frame(spark, sf, fx.FRAMES_JOINED))
    return kp.where("x IS NOT NULL").select(
        "session_id", "frame_idx", "event_id", "joint", "c", ((F.col("x") - 320) / 100).alias("px"),
        ((F.col("y") - 260) / 100).alias("py"), ((F.col("joint") % 5) / 10.0).alias("pz"),
    )


def observations(spark, sf, disturbed: str = "all") -> DataFrame:
    """What each camera sees of each joint: the projection plus a repeatable disturbance.

    ``disturbed``: "all" views a little and some a lot, "one" view of every fifth point a lot, or "none".
    """
    e, j, k = F.col("event_id"), F.col("joint"), F.col("camera_id")
    seen = world(spark, sf).withColumn("camera_id", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    seen = seen.join(F.broadcast(cameras(spark).select("camera_id", "p")), "camera_id")
    u, v = V.projected(seen)
    noise = ((e * (j + 1) * (k + 2)) % 7 - 3) * 0.25
    jump = F.when((e + j * k) % 41 == 0, F.lit(60.0)).otherwise(F.lit(0.0))
    if disturbed != "all":
        off = ((e + j) % 5 == 0) & (k == e % 4) if disturbed == "one" else F.lit(False)
        noise, jump = F.lit(0.0), F.when(off, F.lit(60.0)).otherwise(F.lit(0.0))
    return seen.select(
        "session_id", "frame_idx", "event_id", "joint", "camera_id", "px", "py", "pz", "p", "c", (u + noise + jump).alias("x"), (v - noise).alias("y"),
    )


cte(
    "obs3d_t",
    """SELECT session_id, frame_idx, event_id, joint, camera_id, c, 500*xc/zc + 320 + nx + jump AS x, 500*yc/zc + 240 - nx AS y,
  SQRT(POWER(nx + jump, 2) + POWER(nx, 2)) AS error FROM (
 SELECT *, cs*px + sn*pz AS xc, py AS yc, -sn*px + cs*pz + 10 AS zc, ((event_id*(joint + 1)*(camera_id + 2)) % 7 - 3)*0.25E0 AS nx,
  CASE WHEN (event_id + joint*camera_id) % 41 = 0 THEN 60.0E0 ELSE 0 END AS jump FROM (
  SELECT session_id, frame_idx, event_id, joint, c, (x - 320)/100 AS px, (y - 260)/100 AS py, (joint % 5)/10.0E0 AS pz FROM figure_t WHERE x IS NOT NULL),
  (VALUES (0, 1.0E0, 0.0E0), (1, 0.0E0, 1.0E0), (2, -1.0E0, 0.0E0), (3, 0.0E0, -1.0E0)) t(camera_id, cs, sn))""",
)
VALID_SQL = "c > 0.6E0 AND x > 8 AND x < 632 AND y > 8 AND y < 472"


@query("assemble_views", """SELECT session_id, frame_idx, CAST(event_id % 4 + 1 AS INTEGER) AS n_views, STRING_AGG(v::VARCHAR, ',' ORDER BY v) AS views
FROM frames_t JOIN (SELECT UNNEST(RANGE(4)) AS v) ON v <= event_id % 4 WHERE (event_id*(v + 1)) % 11 <> 0 GROUP BY ALL HAVING COUNT(*) = event_id % 4 + 1""")
def _(spark, sf):
    e = F.col("event_id")
    views = fx.frames(spark, sf).select(
        "session_id", "frame_idx", "event_id", (e % 4 + 1).cast("int").alias("n_views"), F.explode(F.sequence(F.lit(0), (e % 4).cast("int"))).alias("view")
    ).where((e * (F.col("view") + 1)) % 11 != 0)
    out = V.assemble_views(views, ["session_id", "frame_idx"], "view", "n_views")
    return out.withColumn("views", F.array_join(F.transform("views", lambda v: v.cast("string")), ","))


cte(
    "clean3d_t",
    """SELECT *, CASE WHEN zc = 0 THEN NULL ELSE 500*xc/zc + 320 END AS x, CASE WHEN zc = 0 THEN NULL ELSE 500*yc/zc + 240 END AS y, (event_id + joint) % 5 = 0 AND camera_id = event_id % 4 AS off FROM (
 SELECT *, cs*px + sn*pz AS xc, py AS yc, -sn*px + cs*pz + 10 AS zc FROM (
  SELECT session_id, frame_idx, event_id, joint, c, (x - 320)/100 AS px, (y - 260)/100 AS py, (joint % 5)/10.0E0 AS pz FROM figure_t WHERE x IS NOT NULL),
  (VALUES (0, 1.0E0, 0.0E0), (1, 0.0E0, 1.0E0), (2, -1.0E0, 0.0E0), (3, 0.0E0, -1.0E0)) t(camera_id, cs, sn))""",
)


def valid(spark, sf, disturbed="all"):
    cams = cameras(spark).select("camera_id", "width", "height")
    return V.valid_view_keypoints(observations(spark, sf, disturbed), cams, 0.6)


@query("valid_view_keypoints", f"SELECT session_id, frame_idx, joint, camera_id, ROUND(x, 6) AS x, ROUND(y, 6) AS y FROM obs3d_t WHERE {VALID_SQL}")
def _(spark, sf):
    return rounded(valid(spark, sf).select("session_id", "frame_idx", "joint", "camera_id", "x", "y"), "x", "y")


@query("min_views", f"SELECT session_id, frame_idx, joint, COUNT(*) AS n_views FROM obs3d_t WHERE {VALID_SQL} GROUP BY ALL HAVING COUNT(*) >= 3")
def _(spark, sf):
    return V.min_views(valid(spark, sf), 4)


POINTS = ["session_id", "frame_idx", "joint", "px", "py", "pz", "error"]


_point = ", ".join(f"ROUND(ANY_VALUE({c}), 6) + 0.0E0 AS {c}" for c in ("px", "py", "pz"))


@query("triangulate", f"""SELECT session_id, frame_idx, joint, {_point}, 0.0E0 AS error FROM clean3d_t WHERE {VALID_SQL}
GROUP BY session_id, frame_idx, joint HAVING COUNT(*) >= 3""")
def _(spark, sf):
    """Undisturbed views must give the joint itself."""
    solved = V.triangulate(valid(spark, sf, "none"), V.default_min_views(4))
    return rounded(solved.select(*POINTS), *POINTS[3:])


@query("triangulate_disturbed")
def _(spark, sf):
    return V.triangulate(valid(spark, sf), V.default_min_views(4)).select(*POINTS)


@query("drop_worst_view", f"""SELECT session_id, frame_idx, joint, {_point}, 0.0E0 AS error, CAST(MAX(CASE WHEN off THEN camera_id END) AS INTEGER) AS dropped_view
FROM (SELECT * REPLACE (CASE WHEN off THEN x + 60 ELSE x END AS x) FROM clean3d_t) WHERE {VALID_SQL} GROUP BY session_id, frame_idx, joint HAVING COUNT(*) = 4""")
def _(spark, sf):
    """Of four views with one disturbed, that one goes and the joint itself is left."""
    solved = V.drop_worst_view(V.triangulate(valid(spark, sf, "one"), 4), V.max_acceptable_error(640, 480))
    return rounded(solved.select(*POINTS, "dropped_view"), *POINTS[3:])


@query("drop_worst_view_disturbed")
def _(spark, sf):
    solved = V.triangulate(valid(spark, sf), V.default_min_views(4))
    return V.drop_worst_view(solved, V.max_acceptable_error(640, 480)).select(*POINTS, "dropped_view")


@query("reject_outlier_points", """SELECT session_id, frame_idx, joint, ROUND(error, 6) AS error FROM (
 SELECT *, AVG(error) OVER (PARTITION BY session_id, frame_idx) AS m FROM (SELECT session_id, frame_idx, joint, AVG(error) AS error FROM obs3d_t GROUP BY ALL))
WHERE error < 5*m AND error < 25*SQRT(640*480/1310720.0E0)""")
def _(spark, sf):
    obs = V.with_reprojection_error(observations(spark, sf))
    points = obs.groupBy(*V.POINT).agg(
        F.avg("error").alias("error"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("pz").alias("pz")
    )
    kept = V.reject_outlier_points(points, V.max_acceptable_error(640, 480))
    return rounded(kept.select(*V.POINT, "error"), "error")


@query("iterative_outlier_removal", """WITH RECURSIVE e AS (SELECT session_id, frame_idx, joint, camera_id, error FROM obs3d_t),
 r AS (SELECT 0 AS k, 1E9 AS limit_used, (SELECT AVG(error) FROM e) AS m
  UNION ALL SELECT k + 1, GREATEST(2*m, 2.0E0), (SELECT AVG(error) FROM e WHERE error <= GREATEST(2*m, 2.0E0)) FROM r
   WHERE k < 20 AND (k = 0 OR GREATEST(2*m, 2.0E0) < limit_used - 1E-9))
SELECT session_id, frame_idx, joint, camera_id, ROUND(error, 6) AS error FROM e WHERE error <= (SELECT MIN(limit_used) FROM r)""")
def _(spark, sf):
    obs = V.with_reprojection_error(observations(spark, sf)).select(*V.POINT, "camera_id", "error")
    kept, _ = V.iterative_outlier_removal(obs, 2.0)
    return rounded(kept, "error")


@query("multi_view_mask", f"SELECT session_id, frame_idx, joint, camera_id, COUNT(*) OVER (PARTITION BY session_id, frame_idx, joint) > 1 AS usable FROM obs3d_t WHERE {VALID_SQL}")
def _(spark, sf):
    return V.multi_view_mask(valid(spark, sf).select(*V.POINT, "camera_id"))


@query("reprojection_rms", """SELECT camera_id, COUNT(*) AS n, ROUND(SQRT(SUM(error*error)/COUNT(*)), 6) AS rms, ROUND(AVG(error), 6) AS mean_error, ROUND(MAX(error), 6) AS max_error
FROM obs3d_t GROUP BY ROLLUP (camera_id)""")
def _(spark, sf):
    obs = V.with_reprojection_error(observations(spark, sf)).withColumn("point_id", F.col("event_id") * 25 + F.col("joint"))
    out = metrics.reprojection_summary(obs.select("camera_id", "point_id", "error"))
    return rounded(out.drop("max_point"), "rms", "mean_error", "max_error")

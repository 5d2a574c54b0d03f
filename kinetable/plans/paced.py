"""Detection over sessions with their own frame rates and image heights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import metrics, paced, timeseries
from ..streaming import detector
from . import fixtures as fx, pose, stream
from .registry import cte, query, rounded

S4 = timeseries.SERIES
_w = "PARTITION BY session_id ORDER BY frame_idx"
_up = f"({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """5, 10, 12.5 or 30 frames a second, 480 or 720 pixels high."""
    s = F.col("session_id")
    fps = F.element_at(F.array(*[F.lit(x) for x in (5.0, 10.0, 12.5, 30.0)]), (s % 4).cast("int") + 1)
    return fx.sessions(spark, sf).withColumns({"fps": fps, "frame_height": F.lit(480) + 240 * (s % 2)})


def _n(seconds: str) -> str:
    return f"GREATEST(1, CAST(ROUND_EVEN(fps*{seconds}, 0) AS INTEGER))"


cte("pace_t", f"""SELECT *, {_n('0.3E0')} AS gap, {_n('0.15E0')} AS radius, {_n('0.4E0')} AS sp_n, {_n('1.0E0')} AS dr_n, {_n('2.0E0')} AS op_n, {_n('0.5E0')} AS ab_n
FROM (SELECT session_id, label, [5.0E0, 10.0E0, 12.5E0, 30.0E0][1 + session_id % 4] AS fps, CAST(480 + 240*(session_id % 2) AS DOUBLE) AS fh FROM sessions_t)""")
cte("pgeo_t", "SELECT g.*, p.* EXCLUDE (session_id) FROM geo_t g JOIN pace_t p ON p.session_id = g.session_id")
cte("pfill_t", f"""SELECT * EXCLUDE ({', '.join(S4)}), {', '.join(
    f"CASE WHEN {v} IS NOT NULL THEN {v} WHEN {v}_r.i - {v}_l.i - 1 <= gap THEN {v}_l.v + ({v}_r.v - {v}_l.v)*(frame_idx - {v}_l.i)/({v}_r.i - {v}_l.i) END AS {v}" for v in S4)}
FROM (SELECT *, {', '.join(pose._bounds(v) for v in S4)} FROM pgeo_t)""")
cte("psmooth_t", f"""SELECT session_id, frame_idx, detected, body_height, fps, fh, label, sp_n, dr_n, op_n, {', '.join(
    f"MEDIAN({v}) OVER ({_w} ROWS BETWEEN radius PRECEDING AND radius FOLLOWING) AS {v}" for v in S4)} FROM pfill_t""")
cte("pbase_t", """SELECT session_id, GREATEST(COALESCE(MEDIAN(body_height), ANY_VALUE(fh)*0.5E0), ANY_VALUE(fh)*0.15E0) AS bh,
  COALESCE(MEDIAN(hip_y), ANY_VALUE(fh)*0.5E0) AS bhip FROM psmooth_t WHERE frame_idx < op_n GROUP BY session_id""")
cte("pfeat_t", """SELECT s.session_id, frame_idx, detected, fps, label, head_y, hip_y, torso_angle, bbox_aspect, bh AS baseline_body_height, bhip AS baseline_hip_y,
  (hip_y - LAG(hip_y, dr_n) OVER w)/bh AS hip_drop, (head_y - LAG(head_y, dr_n) OVER w)/bh AS head_drop,
  (hip_y - LAG(hip_y, sp_n) OVER w)/bh*(fps/sp_n) AS hip_speed, (head_y - LAG(head_y, sp_n) OVER w)/bh*(fps/sp_n) AS head_speed
FROM psmooth_t s JOIN pbase_t b ON s.session_id = b.session_id WINDOW w AS (PARTITION BY s.session_id ORDER BY frame_idx)""")
cte("pinputs_t", """SELECT *, COALESCE(GREATEST(hip_speed, head_speed), 0) AS speed, COALESCE(GREATEST(hip_drop, head_drop), 0) AS fdrop,
  COALESCE(torso_angle, 0) AS angle, COALESCE(bbox_aspect, 0) AS aspect, COALESCE((hip_y - baseline_hip_y)/baseline_body_height, 0) AS low_hip FROM pfeat_t""")
_configs = ", ".join(
    f"({k}, {c.min_downward_speed!r}E0, {c.min_drop!r}E0, {c.min_torso_angle!r}E0, {c.min_bbox_aspect!r}E0, {c.min_low_hip!r}E0, "
    f"{c.evidence_window_seconds!r}E0, {c.confirmation_seconds!r}E0, {c.missing_confirmation_seconds!r}E0)" for k, c in enumerate(pose.SWEEP)
)
cte("pscored_t", f"""SELECT *, {_n('ev_s')} AS ev, {_n('cf_s')} AS conf, {_n('ls_s')} AS gonef, LEAST(speed/sp, 2.0E0)*0.35E0 + LEAST(fdrop/dr, 2.0E0)*0.25E0 + LEAST(angle/an, 2.0E0)*0.15E0
   + LEAST(aspect/asp, 2.0E0)*0.10E0 + LEAST(GREATEST(low_hip, 0)/lo, 2.0E0)*0.15E0 AS score,
  (speed >= sp AND fdrop >= dr) AS motion, (angle >= an OR aspect >= asp) AS horizontal, low_hip >= lo AS low
FROM pinputs_t CROSS JOIN (VALUES {_configs}) AS t(config_id, sp, dr, an, asp, lo, ev_s, cf_s, ls_s)""")
_cw = "(PARTITION BY config_id, session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ci = "(PARTITION BY config_id, session_id, isl ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
cte("precent_t", f"""SELECT *, recent AND detected AND horizontal AND low AS lying FROM (
  SELECT *, COALESCE(frame_idx - LAST_VALUE(CASE WHEN motion THEN frame_idx END IGNORE NULLS) OVER {_cw} <= ev, FALSE) AS recent FROM pscored_t)""")
cte("pisland_t", f"""SELECT *, SUM(CASE WHEN recent THEN 0 ELSE 1 END) OVER {_cw} AS isl,
  frame_idx - COALESCE(LAST_VALUE(CASE WHEN detected OR NOT recent THEN frame_idx END IGNORE NULLS) OVER {_cw}, -1) AS gone FROM precent_t""")
cte("pwalk_t", f"""SELECT *, s - LEAST(0, MIN(s) OVER {_ci}) AS cand, LAST_VALUE(CASE WHEN lying THEN 'FALL_CANDIDATE' WHEN motion THEN 'FALLING' END IGNORE NULLS) OVER {_ci} AS mark
FROM (SELECT *, SUM(CASE WHEN NOT recent OR NOT detected THEN 0 WHEN lying THEN 1 ELSE -1 END) OVER {_ci} AS s FROM pisland_t)""")
cte("pfallen_t", """SELECT config_id, session_id, fps, label, MIN(frame_idx) FILTER (recent AND (cand >= conf OR gone >= gonef)) AS first_fallen_frame,
  MIN(frame_idx) FILTER (motion) AS first_falling_frame, MAX(score) AS max_score, COALESCE(MAX(GREATEST(hip_speed, head_speed)), 0) AS max_downward_speed,
  COALESCE(MAX(torso_angle), 0) AS max_torso_angle, COALESCE(MAX(bbox_aspect), 0) AS max_bbox_aspect FROM pwalk_t GROUP BY config_id, session_id, fps, label""")


@query("paced_features", f"SELECT session_id, frame_idx, detected, {pose._r(*pose.FEATURES)} FROM pfeat_t")
def _(spark, sf):
    out = paced.extract_features(fx.keypoints(spark, sf), sessions(spark, sf)).drop("fps", "frame_height")
    return rounded(out, *pose.FEATURES)


@query("paced_fall_states", """SELECT w.session_id, frame_idx, ROUND(score, 6) + 0.0E0 AS score, first_fallen_frame,
  CASE WHEN frame_idx >= first_fallen_frame THEN 'FALLEN' WHEN recent THEN mark WHEN detected THEN 'NORMAL' ELSE 'UNKNOWN' END AS state
FROM pwalk_t w JOIN pfallen_t f ON w.session_id = f.session_id AND w.config_id = f.config_id WHERE w.config_id = 0""")
def _(spark, sf):
    out = paced.fall_states(fx.keypoints(spark, sf), sessions(spark, sf))
    return rounded(out.select("session_id", "frame_idx", "state", "first_fallen_frame", "score"), "score")


@query("paced_session_summary", """SELECT session_id, CASE WHEN first_fallen_frame IS NOT NULL THEN 'fall' ELSE 'normal' END AS predicted, first_falling_frame, first_fallen_frame,
  ROUND(first_fallen_frame/fps, 3) AS first_fallen_seconds, ROUND(max_score, 4) AS max_score, ROUND(max_downward_speed, 4) AS max_downward_speed,
  ROUND(max_torso_angle, 3) AS max_torso_angle, ROUND(max_bbox_aspect, 3) AS max_bbox_aspect FROM pfallen_t WHERE config_id = 0""")
def _(spark, sf):
    s = paced.session_summary(fx.keypoints(spark, sf), sessions(spark, sf))
    digits = {"first_fallen_seconds": 3, "max_score": 4, "max_downward_speed": 4, "max_torso_angle": 3, "max_bbox_aspect": 3}
    return s.select("session_id", "predicted", "first_falling_frame", "first_fallen_frame", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("paced_threshold_sweep", pose.metrics_sql(
    "truth", "pred", "config_id", "(SELECT config_id, CAST(label = 'fall' AS INTEGER) AS truth, CAST(first_fallen_frame IS NOT NULL AS INTEGER) AS pred FROM pfallen_t)"))
def _(spark, sf):
    own = sessions(spark, sf)
    swept = paced.threshold_sweep(fx.keypoints(spark, sf), own, pose.SWEEP)
    truth = own.select("session_id", (F.col("label") == "fall").cast("int").alias("truth"))
    hit = swept.join(truth, "session_id").withColumn("pred", F.col("first_fallen_frame").isNotNull().cast("int"))
    return rounded(metrics.binary_metrics(hit, "truth", "pred", ["config_id"]), *pose.M)


# the live rule at each session's pace
_last = lambda v, up=_up: f"LAST_VALUE({v} IGNORE NULLS) OVER {up}"
cte("pheld_t", "SELECT * EXCLUDE (" + ", ".join(S4) + "), " + ", ".join(
    f"CASE WHEN frame_idx - {_last(f'CASE WHEN {v} IS NOT NULL THEN frame_idx END')} <= gap THEN {_last(v)} END AS {v}" for v in S4) + " FROM pgeo_t")
cte("pcsmooth_t", "SELECT session_id, frame_idx, detected, body_height, fps, fh, sp_n, dr_n, op_n, ab_n, " + ", ".join(
    f"MEDIAN({v}) OVER ({_w} ROWS BETWEEN radius PRECEDING AND CURRENT ROW) AS {v}" for v in S4) + " FROM pheld_t")
cte("pcbase_t", """SELECT s.session_id, t, GREATEST(MEDIAN(body_height), ANY_VALUE(fh)*0.15E0) AS bh, COALESCE(MEDIAN(hip_y), ANY_VALUE(fh)*0.5E0) AS bhip
FROM pcsmooth_t s JOIN (SELECT session_id, GREATEST(MAX(op_n) - 1, MIN(frame_idx) FILTER (body_height IS NOT NULL)) AS t FROM pgeo_t GROUP BY 1
  HAVING COUNT(body_height) > 0) c ON c.session_id = s.session_id AND frame_idx <= t GROUP BY s.session_id, t""")
_step = lambda p, n: f"({p}_y - LAG({p}_y, {n}) OVER w)/bh"
cte("pclive_t", f"""SELECT s.session_id, frame_idx, detected, fps, ab_n, t, COALESCE(frame_idx > t, FALSE) AS live, COALESCE(torso_angle, 0) AS angle, COALESCE(bbox_aspect, 0) AS aspect,
  CASE WHEN frame_idx > t THEN COALESCE((hip_y - bhip)/bh, 0) ELSE 0 END AS low_hip,
  CASE WHEN frame_idx > t THEN COALESCE(GREATEST({_step('hip', 'sp_n')}*(fps/sp_n), {_step('head', 'sp_n')}*(fps/sp_n)), 0) ELSE 0 END AS speed,
  CASE WHEN frame_idx > t THEN COALESCE(GREATEST({_step('hip', 'dr_n')}, {_step('head', 'dr_n')}), 0) ELSE 0 END AS fdrop
FROM pcsmooth_t s LEFT JOIN pcbase_t b ON b.session_id = s.session_id WINDOW w AS (PARTITION BY s.session_id ORDER BY frame_idx)""")
cte("pcrecent_t", f"""SELECT *, frame_idx - GREATEST(COALESCE({_last('CASE WHEN detected THEN frame_idx END')}, -1), COALESCE(t, 0)) AS away,
  COALESCE(frame_idx - {_last('CASE WHEN motion THEN frame_idx END')} <= {_n('1.5E0')}, FALSE) AS recent
FROM (SELECT *, live AND speed >= 0.55E0 AND fdrop >= 0.3E0 AS motion, (angle >= 48 OR aspect >= 0.85E0) AND low_hip >= 0.28E0 AS down FROM pclive_t)""")
cte("pcmark_t", f"""SELECT *, recent AND detected AND down AS lying, SUM(CASE WHEN recent THEN 0 ELSE 1 END) OVER {_up} AS isl,
  frame_idx - COALESCE({_last('CASE WHEN detected OR NOT recent THEN frame_idx END')}, -1) AS gone,
  CASE WHEN frame_idx = t THEN 'NORMAL' WHEN recent AND detected AND down THEN 'FALL_CANDIDATE' WHEN motion THEN 'FALLING' WHEN live AND NOT recent AND detected THEN 'NORMAL'
   WHEN live AND NOT recent AND away >= ab_n THEN 'UNKNOWN' END AS mark FROM pcrecent_t""")
_isl = stream._isl
cte("pcwalk_t", f"""SELECT *, s - LEAST(0, MIN(s) OVER {_isl}) AS cand, COALESCE({_last('mark')}, 'UNKNOWN') AS open_state FROM (
 SELECT *, SUM(CASE WHEN NOT recent OR NOT detected THEN 0 WHEN lying THEN 1 ELSE -1 END) OVER {_isl} AS s FROM pcmark_t)""")
cte("pcstates_t", f"""SELECT w.session_id, frame_idx, CASE WHEN fallen THEN 'FALLEN' ELSE open_state END AS state, fallen AS fall_latched, NOT COALESCE(frame_idx >= t, FALSE) AS calibrating, detected,
  CASE WHEN frame_idx >= t THEN LEAST(speed/0.55E0, 2.0E0)*0.35E0 + LEAST(fdrop/0.3E0, 2.0E0)*0.25E0 + LEAST(angle/48, 2.0E0)*0.15E0 + LEAST(aspect/0.85E0, 2.0E0)*0.1E0
   + LEAST(GREATEST(low_hip, 0)/0.28E0, 2.0E0)*0.15E0 ELSE 0 END AS score, speed AS downward_speed, fdrop AS drop_, angle AS torso_angle, aspect AS bbox_aspect, low_hip
FROM (SELECT w.*, COALESCE(frame_idx >= f, FALSE) AS fallen FROM pcwalk_t w JOIN (SELECT session_id, MIN(frame_idx) FILTER (recent AND (cand >= {_n('0.5E0')} OR gone >= {_n('0.5E0')})) AS f
  FROM pcwalk_t GROUP BY 1) x ON x.session_id = w.session_id) w""")


@query("paced_causal_fall_states", stream.LIVE_SQL.replace("cstates_t", "pcstates_t"))
def _(spark, sf):
    return rounded(paced.causal_fall_states(fx.keypoints(spark, sf), sessions(spark, sf)), *stream.OUT)


@query("stream_paced_detector", stream.LIVE_SQL.replace("cstates_t", "pcstates_t"))
def _(spark, sf):
    """One stream of sessions that name their own rate and height."""
    own = sessions(spark, sf).select("session_id", "fps", "frame_height")
    live = stream.live_frames(spark, sf).drop("seconds").join(own, "session_id").withColumn("seconds", F.col("frame_idx") / F.col("fps"))
    return rounded(stream.drained(detector.detect_stream(stream.replay(live, "paced-frames"), detector.LiveConfig()), "paced-states"), *stream.OUT)

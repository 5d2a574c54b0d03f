"""Feature, detection and evaluation queries over sessions of keypoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, geometry, metrics, timeseries
from . import fixtures as fx
from .registry import cte, query, rounded

FPS, H = fx.FPS, fx.HEIGHT
GEO = ["head_x", "head_y", "hip_x", "hip_y", "shoulder_x", "shoulder_y", "torso_angle", "bbox_aspect", "body_height"]


def _wm(axis, joints):
    ok = f"joint IN ({','.join(map(str, joints))}) AND x IS NOT NULL AND y IS NOT NULL AND c >= 0.2E0"
    return f"(SUM({axis}*c) FILTER ({ok})) / (SUM(c) FILTER ({ok}))"


def _pt(axis, first, second):
    return f"COALESCE({_wm(axis, first)}, {_wm(axis, second)})"


_ok = "joint BETWEEN 0 AND 14 AND x IS NOT NULL AND y IS NOT NULL AND c >= 0.2E0"
cte(
    "geo_t",
    f"""SELECT *, DEGREES(ATAN2(ABS(shoulder_x - hip_x), ABS(shoulder_y - hip_y))) AS torso_angle,
  CASE WHEN n >= 5 AND h > 1 THEN w / h END AS bbox_aspect, CASE WHEN n >= 5 AND h > 1 THEN h END AS body_height
FROM (SELECT session_id, frame_idx, BOOL_OR(c >= 0.2E0) AS detected,
  {_pt('x', (0, 1), (2, 5))} AS head_x, {_pt('y', (0, 1), (2, 5))} AS head_y,
  {_pt('x', (8,), (9, 12))} AS hip_x, {_pt('y', (8,), (9, 12))} AS hip_y,
  {_pt('x', (2, 5), (1,))} AS shoulder_x, {_pt('y', (2, 5), (1,))} AS shoulder_y,
  COUNT(*) FILTER ({_ok}) AS n, MAX(x) FILTER ({_ok}) - MIN(x) FILTER ({_ok}) AS w,
  MAX(y) FILTER ({_ok}) - MIN(y) FILTER ({_ok}) AS h
FROM kp_t GROUP BY session_id, frame_idx)""",
)


def _fill(v):
    return f"""CASE WHEN {v} IS NOT NULL THEN {v}
  WHEN {v}_r.i - {v}_l.i - 1 <= 3 THEN {v}_l.v + ({v}_r.v - {v}_l.v)*(frame_idx - {v}_l.i)/({v}_r.i - {v}_l.i) END AS {v}"""


def _bounds(v):
    s = f"CASE WHEN {v} IS NOT NULL THEN {{'i': frame_idx, 'v': {v}}} END"
    return f"""LAST_VALUE({s} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {v}_l,
  FIRST_VALUE({s} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS {v}_r"""


S4 = timeseries.SERIES
cte(
    "fill_t",
    f"""SELECT session_id, frame_idx, detected, body_height, {', '.join(_fill(v) for v in S4)}
FROM (SELECT session_id, frame_idx, detected, body_height, {', '.join(S4)}, {', '.join(_bounds(v) for v in S4)} FROM geo_t)""",
)
cte(
    "smooth_t",
    f"""SELECT session_id, frame_idx, detected, body_height, {', '.join(
        f"MEDIAN({v}) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS {v}" for v in S4)}
FROM fill_t""",
)
cte(
    "base_t",
    f"""SELECT session_id, GREATEST(COALESCE(MEDIAN(body_height), {H}*0.5E0), {H}*0.15E0) AS bh,
  COALESCE(MEDIAN(hip_y), {H}*0.5E0) AS bhip FROM smooth_t WHERE frame_idx < 20 GROUP BY session_id""",
)
cte(
    "feat_t",
    """SELECT s.session_id, frame_idx, detected, head_y, hip_y, torso_angle, bbox_aspect, bh AS baseline_body_height,
  bhip AS baseline_hip_y,
  (hip_y - LAG(hip_y, 10) OVER w)/bh AS hip_drop, (head_y - LAG(head_y, 10) OVER w)/bh AS head_drop,
  (hip_y - LAG(hip_y, 4) OVER w)/bh*10.0E0/4 AS hip_speed, (head_y - LAG(head_y, 4) OVER w)/bh*10.0E0/4 AS head_speed
FROM smooth_t s JOIN base_t b ON s.session_id = b.session_id
WINDOW w AS (PARTITION BY s.session_id ORDER BY frame_idx)""",
)
cte(
    "inputs_t",
    """SELECT *, COALESCE(GREATEST(hip_speed, head_speed), 0) AS speed, COALESCE(GREATEST(hip_drop, head_drop), 0) AS fdrop,
  COALESCE(torso_angle, 0) AS angle, COALESCE(bbox_aspect, 0) AS aspect,
  COALESCE((hip_y - baseline_hip_y)/baseline_body_height, 0) AS low_hip FROM feat_t""",
)
cte(
    "configs_t",
    """SELECT * FROM (VALUES (0, 0.55E0, 0.30E0, 48.0E0, 0.85E0, 0.28E0, 15, 5, 5), (1, 0.40E0, 0.20E0, 40.0E0, 0.70E0, 0.20E0, 15, 5, 5),
  (2, 0.80E0, 0.40E0, 55.0E0, 1.00E0, 0.35E0, 15, 5, 5), (3, 0.55E0, 0.30E0, 48.0E0, 0.85E0, 0.28E0, 30, 15, 8),
  (4, 0.55E0, 0.30E0, 48.0E0, 0.85E0, 0.28E0, 5, 2, 3)) AS t(config_id, sp, dr, an, asp, lo, ev, conf, gonef)""",
)
cte(
    "scored_t",
    """SELECT *, LEAST(speed/sp, 2.0E0)*0.35E0 + LEAST(fdrop/dr, 2.0E0)*0.25E0 + LEAST(angle/an, 2.0E0)*0.15E0
   + LEAST(aspect/asp, 2.0E0)*0.10E0 + LEAST(GREATEST(low_hip, 0)/lo, 2.0E0)*0.15E0 AS score,
  (speed >= sp AND fdrop >= dr) AS motion, (angle >= an OR aspect >= asp) AS horizontal, low_hip >= lo AS low
FROM inputs_t CROSS JOIN configs_t""",
)
cte(
    "recent_t",
    """SELECT *, recent AND detected AND horizontal AND low AS lying FROM (
  SELECT *, COALESCE(frame_idx - LAST_VALUE(CASE WHEN motion THEN frame_idx END IGNORE NULLS) OVER w <= ev, FALSE) AS recent
  FROM scored_t WINDOW w AS (PARTITION BY config_id, session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)
cte(
    "island_t",
    """SELECT *, SUM(CASE WHEN recent THEN 0 ELSE 1 END) OVER w AS isl,
  frame_idx - COALESCE(LAST_VALUE(CASE WHEN detected OR NOT recent THEN frame_idx END IGNORE NULLS) OVER w, -1) AS gone
FROM recent_t WINDOW w AS (PARTITION BY config_id, session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
cte(
    "walk_t",
    """SELECT *, s - LEAST(0, MIN(s) OVER w) AS cand,
  LAST_VALUE(CASE WHEN lying THEN 'FALL_CANDIDATE' WHEN motion THEN 'FALLING' END IGNORE NULLS) OVER w AS mark
FROM (SELECT *, SUM(CASE WHEN NOT recent OR NOT detected THEN 0 WHEN lying THEN 1 ELSE -1 END) OVER w AS s FROM island_t
  WINDOW w AS (PARTITION BY config_id, session_id, isl ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WINDOW w AS (PARTITION BY config_id, session_id, isl ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
cte(
    "fallen_t",
    """SELECT config_id, session_id, MIN(frame_idx) FILTER (recent AND (cand >= conf OR gone >= gonef)) AS first_fallen_frame,
  MIN(frame_idx) FILTER (motion) AS first_falling_frame, MAX(score) AS max_score,
  COALESCE(MAX(GREATEST(hip_speed, head_speed)), 0) AS max_downward_speed, COALESCE(MAX(torso_angle), 0) AS max_torso_angle,
  COALESCE(MAX(bbox_aspect), 0) AS max_bbox_aspect FROM walk_t GROUP BY config_id, session_id""",
)
cte(
    "states_t",
    """SELECT w.*, f.first_fallen_frame, CASE WHEN frame_idx >= f.first_fallen_frame THEN 'FALLEN' WHEN recent THEN mark
  WHEN detected THEN 'NORMAL' ELSE 'UNKNOWN' END AS state
FROM walk_t w JOIN fallen_t f ON w.session_id = f.session_id AND w.config_id = f.config_id WHERE w.config_id = 0""",
)


def _r(*names):
    return ", ".join(f"ROUND({n}, 6) + 0.0E0 AS {n}" for n in names)


@query("frame_geometry", f"SELECT session_id, frame_idx, detected, {_r(*GEO)} FROM geo_t")
def _(spark, sf):
    return rounded(geometry.frame_geometry(fx.keypoints(spark, sf)), *GEO)


@query("fill_short_gaps", f"SELECT session_id, frame_idx, {_r(*S4)} FROM fill_t")
def _(spark, sf):
    g = geometry.frame_geometry(fx.keypoints(spark, sf)).select("session_id", "frame_idx", *S4)
    return rounded(timeseries.fill_short_gaps(g, S4, 3), *S4)


@query(
    "rolling_median",
    f"""SELECT session_id, frame_idx, ROUND(MEDIAN(hip_y) OVER w, 6) AS hip_y, ROUND(MEDIAN(bbox_aspect) OVER w, 6) AS bbox_aspect
FROM geo_t WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
)
def _(spark, sf):
    g = geometry.frame_geometry(fx.keypoints(spark, sf)).select("session_id", "frame_idx", "hip_y", "bbox_aspect")
    return rounded(timeseries.rolling_median(g, ["hip_y", "bbox_aspect"], 2), "hip_y", "bbox_aspect")


@query(
    "trailing_change",
    """SELECT session_id, frame_idx, ROUND(hip_y - LAG(hip_y, 10) OVER w, 6) + 0.0E0 AS hip_drop,
  ROUND(head_y - LAG(head_y, 10) OVER w, 6) + 0.0E0 AS head_drop
FROM geo_t WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx)""",
)
def _(spark, sf):
    g = geometry.frame_geometry(fx.keypoints(spark, sf)).select("session_id", "frame_idx", "hip_y", "head_y")
    out = timeseries.trailing_change(g, {"hip_drop": ("hip_y", 10), "head_drop": ("head_y", 10)})
    return rounded(out.drop("hip_y", "head_y"), "hip_drop", "head_drop")


@query(
    "downward_speed",
    """SELECT session_id, frame_idx, ROUND((hip_y - LAG(hip_y, 4) OVER w)*10.0E0/4, 6) + 0.0E0 AS hip_speed
FROM geo_t WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx)""",
)
def _(spark, sf):
    g = geometry.frame_geometry(fx.keypoints(spark, sf)).select("session_id", "frame_idx", "hip_y")
    out = timeseries.trailing_change(g, {"hip_speed": ("hip_y", 4)}).drop("hip_y")
    return rounded(out.withColumn("hip_speed", F.col("hip_speed") * FPS / 4), "hip_speed")


@query("session_baseline", "SELECT session_id, ROUND(bh, 6) AS baseline_body_height, ROUND(bhip, 6) AS baseline_hip_y FROM base_t")
def _(spark, sf):
    g = geometry.frame_geometry(fx.keypoints(spark, sf))
    return rounded(timeseries.session_baseline(g, FPS, H), "baseline_body_height", "baseline_hip_y")


FEATURES = [*S4, "baseline_body_height", "baseline_hip_y", "hip_drop", "head_drop", "hip_speed", "head_speed"]


@query("extract_features", f"SELECT session_id, frame_idx, detected, {_r(*FEATURES)} FROM feat_t")
def _(spark, sf):
    return rounded(timeseries.extract_features(fx.keypoints(spark, sf), FPS, H), *FEATURES)


@query(
    "fall_score",
    "SELECT session_id, frame_idx, motion, horizontal, low, ROUND(score, 6) + 0.0E0 AS score FROM scored_t WHERE config_id = 0",
)
def _(spark, sf):
    found = detect.fall_score(
        detect.evidence_inputs(timeseries.extract_features(fx.keypoints(spark, sf), FPS, H)),
        detect.threshold_columns(detect.RuleConfig()),
    )
    return rounded(found.select("session_id", "frame_idx", "motion", "horizontal", "low", "score"), "score")


@query("motion_evidence", "SELECT session_id, frame_idx, motion, recent FROM recent_t WHERE config_id = 0")
def _(spark, sf):
    found = detect.fall_evidence(fx.keypoints(spark, sf), FPS, H, detect.RuleConfig())
    return found.select("session_id", "frame_idx", "motion", "recent")


@query(
    "fall_states",
    "SELECT session_id, frame_idx, state, first_fallen_frame, ROUND(score, 6) + 0.0E0 AS score FROM states_t",
)
def _(spark, sf):
    out = detect.fall_states(fx.keypoints(spark, sf), FPS, H)
    return rounded(out.select("session_id", "frame_idx", "state", "first_fallen_frame", "score"), "score")


SUMMARY_SQL = """SELECT f.session_id, s.label AS expected,
  CASE WHEN first_fallen_frame IS NOT NULL THEN 'fall' ELSE 'normal' END AS predicted,
  s.label = CASE WHEN first_fallen_frame IS NOT NULL THEN 'fall' ELSE 'normal' END AS correct,
  first_falling_frame, first_fallen_frame, ROUND(first_fallen_frame/10.0E0, 3) AS first_fallen_seconds,
  ROUND(max_score, 4) AS max_score, ROUND(max_downward_speed, 4) AS max_downward_speed,
  ROUND(max_torso_angle, 3) AS max_torso_angle, ROUND(max_bbox_aspect, 3) AS max_bbox_aspect
FROM fallen_t f JOIN sessions_t s ON f.session_id = s.session_id WHERE config_id = 0"""


@query("session_summary", SUMMARY_SQL)
def session_summary(spark, sf):
    labels = fx.sessions(spark, sf).select("session_id", F.col("label").alias("expected"))
    s = detect.session_summary(fx.keypoints(spark, sf), FPS, H).join(labels, "session_id")
    return s.select(
        "session_id", "expected", "predicted", (F.col("expected") == F.col("predicted")).alias("correct"),
        "first_falling_frame", "first_fallen_frame",
        *[F.round(c, d).alias(c) for c, d in (
            ("first_fallen_seconds", 3), ("max_score", 4), ("max_downward_speed", 4),
            ("max_torso_angle", 3), ("max_bbox_aspect", 3))],
    )


SWEEP = [
    detect.RuleConfig(),
    detect.RuleConfig(0.40, 0.20, 40.0, 0.70, 0.20),
    detect.RuleConfig(0.80, 0.40, 55.0, 1.00, 0.35),
    detect.RuleConfig(evidence_window_seconds=3.0, confirmation_seconds=1.5, missing_confirmation_seconds=0.8),
    detect.RuleConfig(evidence_window_seconds=0.5, confirmation_seconds=0.2, missing_confirmation_seconds=0.3),
]


def metrics_sql(truth, pred, group="", source=""):
    """Confusion metrics with zero-safe ratios."""
    sel = f"{group}, " if group else ""
    return f"""SELECT {sel}samples, tp, tn, fp, fn,
  ROUND(CASE WHEN samples > 0 THEN (tp + tn)/CAST(samples AS DOUBLE) ELSE 0 END, 6) AS accuracy,
  ROUND(p, 6) AS "precision", ROUND(r, 6) AS recall, ROUND(CASE WHEN p + r > 0 THEN 2*p*r/(p + r) ELSE 0 END, 6) AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp/CAST(tp + fp AS DOUBLE) ELSE 0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp/CAST(tp + fn AS DOUBLE) ELSE 0 END AS r
 FROM (SELECT {sel}COUNT(*) AS samples, COUNT(*) FILTER ({truth} = 1 AND {pred} = 1) AS tp,
  COUNT(*) FILTER ({truth} = 0 AND {pred} = 0) AS tn, COUNT(*) FILTER ({truth} = 0 AND {pred} = 1) AS fp,
  COUNT(*) FILTER ({truth} = 1 AND {pred} = 0) AS fn FROM {source}{f' GROUP BY {group}' if group else ''}))"""


cte(
    "verdict_t",
    """SELECT f.config_id, f.session_id, s.category, CAST(s.label = 'fall' AS INTEGER) AS truth,
  CAST(first_fallen_frame IS NOT NULL AS INTEGER) AS pred FROM fallen_t f JOIN sessions_t s ON f.session_id = s.session_id""",
)


def verdicts(spark, sf):
    """(session_id, category, truth, pred) of the default rule."""
    s = fx.sessions(spark, sf).select("session_id", "category", (F.col("label") == "fall").cast("int").alias("truth"))
    found = detect.fall_evidence(fx.keypoints(spark, sf), FPS, H, detect.RuleConfig())
    falls = detect.first_fallen(found, FPS, detect.RuleConfig())
    return falls.join(s, "session_id").select(
        "session_id", "category", "truth", F.col("first_fallen_frame").isNotNull().cast("int").alias("pred")
    )


M = ["accuracy", "precision", "recall", "f1"]


@query("threshold_sweep", metrics_sql("truth", "pred", "config_id", "verdict_t"))
def _(spark, sf):
    truth = fx.sessions(spark, sf).select("session_id", (F.col("label") == "fall").cast("int").alias("truth"))
    swept = detect.threshold_sweep(fx.keypoints(spark, sf), FPS, H, SWEEP).join(truth, "session_id")
    hit = swept.withColumn("pred", F.col("first_fallen_frame").isNotNull().cast("int"))
    return rounded(metrics.binary_metrics(hit, "truth", "pred", ["config_id"]), *M)


@query("binary_metrics", metrics_sql("truth", "pred", "", "(SELECT * FROM verdict_t WHERE config_id = 0)"))
def _(spark, sf):
    return rounded(metrics.binary_metrics(verdicts(spark, sf), "truth", "pred"), *M)


_vg = """(SELECT 'overall' AS grp, truth, pred FROM verdict_t WHERE config_id = 0
  UNION ALL SELECT category, truth, pred FROM verdict_t WHERE config_id = 0)"""


@query("metrics_by_group", metrics_sql("truth", "pred", "grp", _vg))
def _(spark, sf):
    out = metrics.metrics_by_group(verdicts(spark, sf), "truth", "pred", "category")
    return rounded(out.withColumnRenamed("category", "grp"), *M)


@query(
    "first_errors",
    """SELECT session_id, category, truth, pred, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY session_id) AS rn FROM verdict_t WHERE config_id = 0 AND truth <> pred) WHERE rn <= 100""",
)
def _(spark, sf):
    wrong = verdicts(spark, sf).where("truth <> pred")
    return metrics.first_n(wrong, ["session_id"], 100, "rank")

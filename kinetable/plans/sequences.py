"""Queries over frame sequences: model inputs, clips, rates, runs and evaluation searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, people, sequences as S, timeseries
from ..operators.chunks import time_bucket
from ..operators.geometry import frame_geometry
from . import fixtures as fx
from .pose import metrics_sql
from .registry import cte, query, rounded, table

def seconds():
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 4.0E10")


SEC_SQL = "(DATE_DIFF('microsecond', TIMESTAMP '2024-01-01', ts)/4.0E10)"


def _r(*names, d=6):
    return ", ".join(f"ROUND({n}, {d}) + 0.0E0 AS {n}" for n in names)


@query("joint_quality", f"""SELECT session_id, joint, {_r('mean_confidence', 'valid_ratio', d=9)} FROM (SELECT session_id, joint, AVG(c) AS mean_confidence,
  AVG(CASE WHEN c >= 0.3E0 THEN 1.0E0 ELSE 0 END) AS valid_ratio FROM kp_t GROUP BY session_id, joint)""")
def _(spark, sf):
    return rounded(metrics.joint_quality(fx.keypoints(spark, sf)), "mean_confidence", "valid_ratio", digits=9)


@query("detected_ratio", """SELECT session_id, COUNT(*) AS frames, COUNT(*) FILTER (seen) AS detected, COUNT(*) FILTER (NOT seen) AS missing,
  ROUND(AVG(CASE WHEN seen THEN 1.0E0 ELSE 0 END), 6) AS detected_ratio
FROM (SELECT session_id, frame_idx, MAX(c) > 0 AS seen FROM kp_t GROUP BY ALL) GROUP BY session_id""")
def _(spark, sf):
    return rounded(metrics.session_quality(fx.keypoints(spark, sf)), "detected_ratio")


@query("split_counts", """SELECT s.split, CAST(t.truth AS VARCHAR) AS truth, CAST(COUNT(k.clip_id) AS BIGINT) AS n
FROM (VALUES ('train'), ('validation'), ('test'), ('holdout')) s(split) CROSS JOIN (VALUES ('0'), ('1')) t(truth)
LEFT JOIN scores_t k ON k.split = s.split AND CAST(k.truth AS VARCHAR) = t.truth GROUP BY ALL""")
def _(spark, sf):
    rows = fx.clip_scores(spark, sf).select("split", F.col("truth").cast("string").alias("truth"))
    return metrics.split_counts(rows, {"split": ["train", "validation", "test", "holdout"], "truth": ["0", "1"]})


WEIGHTS3 = [(a / 10.0, b / 10.0, (10 - a - b) / 10.0) for a in range(11) for b in range(11 - a)]
THRESHOLDS = metrics.threshold_steps(0.25, 0.025, 21)
WEIGHTS2 = [(i * 0.05, 1.0 - i * 0.05) for i in range(21)]
NAMES = ["samples", "tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "f1"]


def _grid_sql(weights, blend):
    """Every cell scored from scratch: rows x weights x thresholds."""
    return metrics_sql(
        "truth", "pred", "split, weight_id, threshold_id, threshold, w",
        f"(SELECT split, truth, w, weight_id, threshold_id, threshold, CAST({blend} >= threshold AS INTEGER) AS pred FROM scores_t, ({weights}), "
        "(SELECT k AS threshold_id, 0.25E0 + k*0.025E0 AS threshold FROM (SELECT UNNEST(RANGE(21)) AS k)) WHERE split <> 'train')",
    )


def _pick_sql(grid, order, weights):
    cols = ", ".join(
        f"{a}.\"{n}\" AS {p}_{n}" for a, p in (("v", "validation"), ("t", "test")) for n in NAMES
    )
    return f"""WITH g AS ({grid}), v AS (SELECT * FROM g WHERE split = 'validation' ORDER BY {order}, weight_id, threshold_id LIMIT 1)
SELECT {weights}, ROUND(v.threshold, 6) AS threshold, {cols} FROM v JOIN g t ON t.split = 'test' AND t.weight_id = v.weight_id AND t.threshold_id = v.threshold_id"""


_w3 = """SELECT ROW_NUMBER() OVER (ORDER BY a, b) - 1 AS weight_id, {'a': a/10.0E0, 'b': b/10.0E0, 'c': (10 - a - b)/10.0E0} AS w
  FROM (SELECT UNNEST(RANGE(11)) AS a), (SELECT UNNEST(RANGE(11)) AS b) WHERE a + b <= 10"""
_w2 = "SELECT k AS weight_id, {'a': k*0.05E0, 'b': 1.0E0 - k*0.05E0} AS w FROM (SELECT UNNEST(RANGE(21)) AS k)"


@query(
    "ensemble_search3",
    _pick_sql(
        _grid_sql(_w3, "(w.a*p_legacy + w.b*p_pose + w.c*p_engineered)"), "f1 DESC, accuracy DESC, recall DESC",
        "ROUND(v.w.a, 6) AS w_legacy, ROUND(v.w.b, 6) AS w_pose, ROUND(v.w.c, 6) AS w_engineered",
    ),
)
def _(spark, sf):
    scores = ["p_legacy", "p_pose", "p_engineered"]
    grid = metrics.score_grid(
        fx.clip_scores(spark, sf).where("split <> 'train'"), "truth", WEIGHTS3, scores, THRESHOLDS, ["split"]
    )
    grid = rounded(grid, "accuracy", "precision", "recall", "f1")
    best = metrics.best_cell(grid, ["f1", "accuracy", "recall"], "split", "validation", "test")
    best = best.drop("weight_id", "threshold_id").withColumnsRenamed({f"w_{s}": f"w_{s[2:]}" for s in scores})
    return rounded(best, "threshold", "w_legacy", "w_pose", "w_engineered")


@query(
    "ensemble_search_recall",
    _pick_sql(
        _grid_sql(_w2, "(w.a*p_pose + w.b*p_engineered)"),
        'CASE WHEN recall >= 0.95E0 THEN 1 ELSE 0 END DESC, CASE WHEN recall >= 0.95E0 THEN "precision" ELSE recall END DESC, f1 DESC',
        "ROUND(v.w.a, 6) AS w_pose, ROUND(v.w.b, 6) AS w_engineered",
    ),
)
def _(spark, sf):
    scores = ["p_pose", "p_engineered"]
    grid = metrics.score_grid(
        fx.clip_scores(spark, sf).where("split <> 'train'"), "truth", WEIGHTS2, scores, THRESHOLDS, ["split"]
    )
    grid = rounded(grid, "accuracy", "precision", "recall", "f1")
    enough = F.col("recall") >= 0.95
    rank = [enough.cast("int"), F.when(enough, F.col("precision")).otherwise(F.col("recall")), F.col("f1")]
    best = metrics.best_cell(grid, rank, "split", "validation", "test")
    best = best.drop("weight_id", "threshold_id").withColumnsRenamed({f"w_{s}": f"w_{s[2:]}" for s in scores})
    return rounded(best, "threshold", "w_pose", "w_engineered")


#: All elements of the vectors; a label is one of the first ten classes.
LOGITS = [f"z{i}" for i in range(64)]


def logits(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", *[e[i].cast("double").alias(z) for i, z in enumerate(LOGITS)]
    )


cte("logits_t", "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {z}" for i, z in enumerate(LOGITS)) + " FROM embeddings")
_own = "([" + ",".join(LOGITS) + "])[label + 1]"


@query("cross_entropy", f"""SELECT ROUND(AVG(LN({' + '.join(f'EXP({z})' for z in LOGITS)}) - {_own}), 6) AS mean_loss, COUNT(*) AS samples,
  COUNT(*) FILTER (LIST_POSITION([{','.join(LOGITS)}], GREATEST({','.join(LOGITS)})) - 1 = label) AS correct FROM logits_t""")
def _(spark, sf):
    return rounded(metrics.cross_entropy(logits(spark, sf), LOGITS, "label"), "mean_loss")


@query("topk_accuracy", f"""SELECT label, COUNT(*) AS samples, ROUND(AVG(CASE WHEN b < 1 THEN 1.0E0 ELSE 0 END), 6) AS top1,
  ROUND(AVG(CASE WHEN b < 3 THEN 1.0E0 ELSE 0 END), 6) AS top3
FROM (SELECT label, {' + '.join(f'CAST({z} >= {_own} AS INTEGER)' for z in LOGITS)} - 1 AS b FROM logits_t WHERE label <> 9) GROUP BY label""")
def _(spark, sf):
    return rounded(metrics.topk_accuracy(logits(spark, sf), LOGITS, "label", [1, 3], 9, ["label"]), "top1", "top3")


@query("latency_summary", f"""SELECT session_id, COUNT(*) AS frames, ROUND(MIN_BY(value, frame_idx), 6) AS warmup,
  ROUND(MEDIAN(value) FILTER (frame_idx > 0), 6) AS median, ROUND(QUANTILE_CONT(value, 0.95) FILTER (frame_idx > 0), 6) AS p95,
  ROUND(COUNT(*)/(MAX({SEC_SQL}) - MIN({SEC_SQL})), 6) AS average_fps FROM frames_t GROUP BY session_id""")
def _(spark, sf):
    return rounded(S.latency_summary(fx.frames(spark, sf), "value", seconds()), "warmup", "median", "p95", "average_fps")


@query("profile_timings", """SELECT event_type, CAST((rn - 1)//50 AS BIGINT) AS batch, ROUND(AVG(value), 6) AS average
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL HAVING COUNT(*) = 50""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    return rounded(S.profile_timings(ev, "event_type", "value", ["ts", "event_id"], time_bucket("ts"), 50), "average")


cte("hist_t", """SELECT o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS epoch, o_totalprice/1.0E6 AS f1 FROM orders""")


@query("training_history_best", """WITH a AS (SELECT *, f1 > COALESCE(MAX(f1) OVER (PARTITION BY o_custkey ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM hist_t),
 b AS (SELECT *, LAST_VALUE(CASE WHEN better THEN epoch END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY epoch) AS best FROM a),
 c AS (SELECT o_custkey, MIN(epoch) FILTER (epoch - best >= 4) AS stop_epoch, MAX(epoch) AS last_epoch FROM b GROUP BY 1)
SELECT c.o_custkey, stop_epoch, b.best AS best_epoch, ROUND(h.f1, 6) AS best_metric FROM c JOIN b ON b.o_custkey = c.o_custkey AND b.epoch = COALESCE(stop_epoch, last_epoch)
 JOIN hist_t h ON h.o_custkey = c.o_custkey AND h.epoch = b.best""")
def _(spark, sf):
    from ..operators.chunks import dense_index

    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1e6).alias("f1"))
    hist = dense_index(o, ["o_custkey"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 100000), "epoch")
    return rounded(S.training_history_best(hist, "o_custkey", "epoch", "f1", 4), "best_metric")


@query("circular_mean", f"""SELECT user_id, n, ROUND(CASE WHEN m > PI() THEN m - 2*PI() ELSE m END, 6) + 0.0E0 AS mean_angle, consistent FROM (
 SELECT user_id, n, CASE WHEN wide THEN mb ELSE CASE WHEN ma < 0 THEN ma + 2*PI() ELSE ma END END AS m,
  CASE WHEN wide THEN rb ELSE ra END < PI() AS consistent FROM (
  SELECT user_id, COUNT(*) AS n, MAX(a) - MIN(a) >= PI() AS wide, MAX(a) - MIN(a) AS ra, MAX(b) - MIN(b) AS rb, AVG(a) AS ma, AVG(b) AS mb
  FROM (SELECT user_id, b, CASE WHEN b > PI() THEN b - 2*PI() ELSE b END AS a FROM (
   SELECT user_id, v - 2*PI()*FLOOR(v/(2*PI())) AS b FROM (SELECT user_id, (user_id % 11) + value/80 AS v FROM events))) GROUP BY user_id))""")
def _(spark, sf):
    ang = table(spark, sf, "events").select("user_id", (F.col("user_id") % 11 + F.col("value") / 80).alias("angle"))
    return rounded(metrics.circular_mean(ang, "user_id", "angle"), "mean_angle")


cte("seenkp_t", "SELECT *, c > 0 AND x IS NOT NULL AND y IS NOT NULL AS ok FROM kp_t")
cte(
    "bodyframe_t",
    """SELECT session_id, COALESCE(MEDIAN(px) FILTER (frame_idx < early), 0) AS ox, COALESCE(MEDIAN(py) FILTER (frame_idx < early), 0) AS oy,
  GREATEST(COALESCE(MEDIAN(torso) FILTER (torso > 1E-3), MEDIAN(span), 1.0E0), 1E-3) AS sc
FROM (SELECT *, GREATEST(ROUND_EVEN((MAX(frame_idx) OVER (PARTITION BY session_id) + 1)*0.2E0, 0), 1) AS early FROM (
  SELECT session_id, frame_idx, MAX(x) FILTER (ok AND joint = 8) AS px, MAX(y) FILTER (ok AND joint = 8) AS py,
   SQRT(POWER(MAX(x) FILTER (ok AND joint = 1) - MAX(x) FILTER (ok AND joint = 8), 2) + POWER(MAX(y) FILTER (ok AND joint = 1) - MAX(y) FILTER (ok AND joint = 8), 2)) AS torso,
   GREATEST(MAX(x) FILTER (ok) - MIN(x) FILTER (ok), MAX(y) FILTER (ok) - MIN(y) FILTER (ok)) AS span
  FROM seenkp_t GROUP BY session_id, frame_idx)) GROUP BY session_id""",
)
cte(
    "posefeat_t",
    """SELECT k.session_id, frame_idx, joint, CASE WHEN ok THEN LEAST(GREATEST((x - ox)/sc, -8), 8) ELSE 0 END AS x,
  CASE WHEN ok THEN LEAST(GREATEST((y - oy)/sc, -8), 8) ELSE 0 END AS y, CASE WHEN ok THEN c ELSE 0 END AS c
FROM seenkp_t k JOIN bodyframe_t b ON k.session_id = b.session_id""",
)


@query("pose_features", f"SELECT session_id, frame_idx, joint, {_r('x', 'y', 'c')} FROM posefeat_t")
def _(spark, sf):
    return rounded(S.FEATURE_SETS["pose"](fx.keypoints(spark, sf)), "x", "y", "c")


def _grad(c):
    return f"""CASE WHEN LAG({c}) OVER w IS NOT NULL AND LEAD({c}) OVER w IS NOT NULL THEN (LEAD({c}) OVER w - LAG({c}) OVER w)/2
  WHEN LEAD({c}) OVER w IS NOT NULL THEN LEAD({c}) OVER w - {c} ELSE {c} - LAG({c}) OVER w END"""


@query(
    "engineered_features",
    f"""SELECT session_id, frame_idx, {_r(*S.ENGINEERED)} FROM (
 SELECT *, box_width/GREATEST(box_height, 1E-3) AS aspect, {_grad('hip_x')} AS hip_vx, {_grad('hip_y')} AS hip_vy, {_grad('head_y')} AS head_vy FROM (
  SELECT session_id, frame_idx, MAX(x) FILTER (joint = 8) AS hip_x, MAX(y) FILTER (joint = 8) AS hip_y, MAX(x) FILTER (joint = 0) AS head_x,
   MAX(y) FILTER (joint = 0) AS head_y, MAX(x) FILTER (joint = 1) - MAX(x) FILTER (joint = 8) AS torso_x, MAX(y) FILTER (joint = 1) - MAX(y) FILTER (joint = 8) AS torso_y,
   COALESCE(MAX(x) FILTER (c > 0) - MIN(x) FILTER (c > 0), 0) AS box_width, COALESCE(MAX(y) FILTER (c > 0) - MIN(y) FILTER (c > 0), 0) AS box_height,
   COUNT(*) FILTER (c > 0)/25.0E0 AS coverage FROM posefeat_t GROUP BY session_id, frame_idx)
 WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx))""",
)
def _(spark, sf):
    return rounded(S.FEATURE_SETS["engineered"](fx.keypoints(spark, sf)), *S.ENGINEERED)


cte("legacy_t", "SELECT session_id, frame_idx, joint, CASE WHEN ok THEN x/640.0E0 ELSE 0 END AS x, CASE WHEN ok THEN y/480.0E0 ELSE 0 END AS y, CASE WHEN ok THEN c ELSE 0 END AS c FROM seenkp_t")


@query("legacy_features", f"SELECT session_id, frame_idx, joint, {', '.join(f'ROUND({v} + 1E-11, 9) AS {v}' for v in 'xyc')} FROM legacy_t")
def _(spark, sf):
    return rounded(S.FEATURE_SETS["legacy"](fx.keypoints(spark, sf)), "x", "y", "c", digits=9, nudge=1e-11)


@query(
    "resample_sequence",
    f"""WITH n AS (SELECT session_id, joint, MAX(frame_idx) AS last FROM legacy_t GROUP BY ALL),
 t AS (SELECT session_id, joint, CAST(k AS INTEGER) AS step, k*last/15.0E0 AS pos, last FROM n, (SELECT UNNEST(RANGE(16)) AS k))
SELECT t.session_id, t.joint, step, {', '.join(f'ROUND(a.{v}*(1 - (pos - FLOOR(pos))) + b.{v}*(pos - FLOOR(pos)) + 1E-11, 9) AS {v}' for v in 'xyc')}
FROM t JOIN legacy_t a ON a.session_id = t.session_id AND a.joint = t.joint AND a.frame_idx = FLOOR(pos)
 JOIN legacy_t b ON b.session_id = t.session_id AND b.joint = t.joint AND b.frame_idx = LEAST(FLOOR(pos) + 1, last)""",
)
def _(spark, sf):
    rows = S.FEATURE_SETS["legacy"](fx.keypoints(spark, sf))
    return rounded(S.resample_sequence(rows, ["x", "y", "c"], 16, ["session_id", "joint"]), "x", "y", "c", digits=9, nudge=1e-11)


@query(
    "sliding_clips",
    """SELECT e.session_id, e.frame_idx AS clip_end, MIN(f.frame_idx) AS clip_start, COUNT(*) AS n, ROUND(AVG(f.value), 6) AS mean_value
FROM frames_t e JOIN frames_t f ON e.session_id = f.session_id AND f.frame_idx BETWEEN e.frame_idx - 39 AND e.frame_idx
WHERE (e.frame_idx + 1) % 3 = 0 GROUP BY ALL""",
)
def _(spark, sf):
    clips = S.sliding_clips(fx.frames(spark, sf).select("session_id", "frame_idx", "value"), 40, 3)
    out = clips.groupBy("session_id", "clip_end").agg(
        F.min("frame_idx").alias("clip_start"), F.count("*").alias("n"), F.avg("value").alias("mean_value")
    )
    return rounded(out, "mean_value")


cte(
    "evals_t",
    """SELECT f.session_id, f.frame_idx, CAST((f.frame_idx + 1)/3 - 1 AS BIGINT) AS i,
  LEAST(0.5E0*((event_id*37) % 1000/1000.0E0) + 0.5E0*((event_id*53) % 1000/1000.0E0) + f.frame_idx/100.0E0, 1) AS p, s.torso_angle, s.bbox_aspect
FROM frames_t f JOIN smooth_t s ON f.session_id = s.session_id AND f.frame_idx = s.frame_idx WHERE (f.frame_idx + 1) % 3 = 0""",
)


@query(
    "classifier_hysteresis",
    """WITH d AS (SELECT *, CASE WHEN COALESCE(p >= 0.8E0 AND (torso_angle >= 40 OR bbox_aspect >= 0.7E0), FALSE) THEN 3 ELSE -3 END AS d FROM evals_t),
 s AS (SELECT *, SUM(d) OVER (PARTITION BY session_id ORDER BY i) AS s FROM d),
 c AS (SELECT *, s - LEAST(0, MIN(s) OVER (PARTITION BY session_id ORDER BY i)) AS c FROM s)
SELECT session_id, frame_idx, ROUND(p, 6) AS p, CAST(c AS BIGINT) AS counter, c >= 5 AS alarm FROM c""",
)
def _(spark, sf):
    fr = fx.frames(spark, sf)
    e = F.col("event_id")
    blend = 0.5 * ((e * 37) % 1000 / 1000.0) + 0.5 * ((e * 53) % 1000 / 1000.0) + F.col("frame_idx") / 100.0
    probs = fr.where((F.col("frame_idx") + 1) % 3 == 0).select(
        "session_id", "frame_idx", F.least(blend, F.lit(1.0)).alias("p")
    )
    g = frame_geometry(fx.keypoints(spark, sf))
    from ..operators.chunks import core, halo

    r = timeseries.reach(fx.FPS)
    wide = halo(g.select("session_id", "frame_idx", "torso_angle", "bbox_aspect"), "frame_idx", r, r)
    posture = core(timeseries.smoothed(wide, fx.FPS, ["torso_angle", "bbox_aspect"])).drop("_chunk")
    scored = probs.join(posture, ["session_id", "frame_idx"]).select(
        "session_id", "frame_idx", "p", F.col("torso_angle").alias("angle"), F.col("bbox_aspect").alias("aspect"),
        F.floor((F.col("frame_idx") + 1) / 3 - 1).alias("eval_idx"),
    )
    out = S.classifier_hysteresis(scored, 3, 5).select("session_id", "frame_idx", "p", "counter", "alarm")
    return rounded(out, "p")


@query(
    "estimate_fps",
    f"""WITH g AS (SELECT session_id, COUNT(*) AS n, MEDIAN(d) FILTER (d > 0.001E0 AND d < 2.0E0) AS m FROM (
  SELECT session_id, {SEC_SQL} - LAG({SEC_SQL}) OVER (PARTITION BY session_id ORDER BY frame_idx) AS d FROM frames_t) GROUP BY 1)
SELECT session_id, ROUND(CASE WHEN n >= 5 AND m IS NOT NULL THEN LEAST(GREATEST(1/m, 1), 60) ELSE 12.5E0 END, 6) AS fps FROM g""",
)
def _(spark, sf):
    return rounded(S.estimate_fps(fx.frames(spark, sf), seconds(), 12.5), "fps")


@query(
    "rolling_fps",
    f"""SELECT session_id, frame_idx, ROUND((COUNT(*) OVER w - 1)/CASE WHEN t = FIRST_VALUE(t) OVER w THEN 1 ELSE t - FIRST_VALUE(t) OVER w END, 6) AS fps
FROM (SELECT session_id, frame_idx, {SEC_SQL} AS t FROM frames_t) WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    out = S.rolling_fps(fx.frames(spark, sf).select("session_id", "frame_idx", "ts"), seconds()).drop("ts")
    return rounded(out, "fps")


@query(
    "empty_runs",
    """SELECT session_id, MIN(frame_idx) AS first_frame, COUNT(*) AS length, COUNT(*) >= 3 AS too_long FROM (
 SELECT *, frame_idx - ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame_idx) AS g FROM frames_t WHERE event_type IN ('error', 'signup')) GROUP BY session_id, g""",
)
def _(spark, sf):
    return S.empty_runs(fx.frames(spark, sf), F.col("event_type").isin("error", "signup"), 3)


@query(
    "assign_frame_ids",
    """SELECT session_id, event_id, CAST(v AS INTEGER) AS view_idx, CASE WHEN event_id % 10 = 0 THEN 1000000 + event_id ELSE frame_idx END AS frame_id
FROM frames_t JOIN (SELECT UNNEST(RANGE(4)) AS v) ON v <= event_id % 4""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts")
    views = ev.withColumn("view_idx", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")))).withColumn(
        "given", F.when(F.col("event_id") % 10 == 0, F.col("event_id") + 1000000)
    )
    out = S.assign_frame_ids(views, ["ts", "event_id"], time_bucket("ts"), "given")
    return out.select("session_id", "event_id", "view_idx", "frame_id")


@query("augment_sequences")
def _(spark, sf):
    rows = S.FEATURE_SETS["legacy"](fx.keypoints(spark, sf))
    return S.augment_sequences(rows, 16, 7)

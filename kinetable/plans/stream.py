"""Streaming queries: the derived frames are written as files and read back as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import causal
from ..operators.geometry import frame_geometry
from ..scratch import new_folder
from ..streaming import detector, flows
from . import fixtures as fx
from .registry import cte, query, rounded, table


def replay(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the checkpoint folder and open it as a stream."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def drained(stream: DataFrame, name: str) -> DataFrame:
    root = new_folder(stream.sparkSession, name)
    return flows.run_to_table(stream, f"{root}/out", f"{root}/checkpoint")


def live_frames(spark, sf) -> DataFrame:
    g = frame_geometry(fx.keypoints(spark, sf))
    return g.select(
        "session_id", "frame_idx", (F.col("frame_idx") / fx.FPS).alias("seconds"), "detected",
        *causal.SERIES, "body_height", F.lit(None).cast("string").alias("control"),
    )


LIVE = detector.LiveConfig(frame_height=fx.HEIGHT, fps=fx.FPS)
OUT = ["score", "downward_speed", "drop", "torso_angle", "bbox_aspect", "low_hip"]

S4 = causal.SERIES
_w = "PARTITION BY session_id ORDER BY frame_idx"
cte(
    "held_t",
    "SELECT session_id, frame_idx, detected, body_height, " + ", ".join(
        f"CASE WHEN frame_idx - LAST_VALUE(CASE WHEN {v} IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 3 "
        f"THEN LAST_VALUE({v} IGNORE NULLS) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS {v}" for v in S4
    ) + " FROM geo_t",
)
cte(
    "csmooth_t",
    "SELECT session_id, frame_idx, detected, body_height, " + ", ".join(
        f"MEDIAN({v}) OVER ({_w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {v}" for v in S4
    ) + " FROM held_t",
)
cte(
    "cbase_t",
    f"""SELECT s.session_id, t, GREATEST(MEDIAN(body_height), {fx.HEIGHT}*0.15E0) AS bh, COALESCE(MEDIAN(hip_y), {fx.HEIGHT}*0.5E0) AS bhip
FROM csmooth_t s JOIN (SELECT session_id, GREATEST(19, MIN(frame_idx) FILTER (body_height IS NOT NULL)) AS t FROM geo_t GROUP BY 1
  HAVING COUNT(body_height) > 0) c ON c.session_id = s.session_id AND frame_idx <= t GROUP BY s.session_id, t""",
)
cte(
    "clive_t",
    """SELECT s.session_id, frame_idx, detected, t, COALESCE(frame_idx > t, FALSE) AS live, COALESCE(torso_angle, 0) AS angle, COALESCE(bbox_aspect, 0) AS aspect,
  CASE WHEN frame_idx > t THEN COALESCE((hip_y - bhip)/bh, 0) ELSE 0 END AS low_hip,
  CASE WHEN frame_idx > t THEN COALESCE(GREATEST((hip_y - LAG(hip_y, 4) OVER w)/bh*2.5E0, (head_y - LAG(head_y, 4) OVER w)/bh*2.5E0), 0) ELSE 0 END AS speed,
  CASE WHEN frame_idx > t THEN COALESCE(GREATEST((hip_y - LAG(hip_y, 10) OVER w)/bh, (head_y - LAG(head_y, 10) OVER w)/bh), 0) ELSE 0 END AS fdrop
FROM csmooth_t s LEFT JOIN cbase_t b ON b.session_id = s.session_id WINDOW w AS (PARTITION BY s.session_id ORDER BY frame_idx)""",
)
_up = f"({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
cte(
    "crecent_t",
    f"""SELECT *, frame_idx - GREATEST(COALESCE(LAST_VALUE(CASE WHEN detected THEN frame_idx END IGNORE NULLS) OVER {_up}, -1), COALESCE(t, 0)) AS away,
  COALESCE(frame_idx - LAST_VALUE(CASE WHEN motion THEN frame_idx END IGNORE NULLS) OVER {_up} <= 15, FALSE) AS recent
FROM (SELECT *, live AND speed >= 0.55E0 AND fdrop >= 0.3E0 AS motion, (angle >= 48 OR aspect >= 0.85E0) AND low_hip >= 0.28E0 AS down FROM clive_t)""",
)
cte(
    "cmark_t",
    f"""SELECT *, recent AND detected AND down AS lying, SUM(CASE WHEN recent THEN 0 ELSE 1 END) OVER {_up} AS isl,
  frame_idx - COALESCE(LAST_VALUE(CASE WHEN detected OR NOT recent THEN frame_idx END IGNORE NULLS) OVER {_up}, -1) AS gone,
  CASE WHEN frame_idx = t THEN 'NORMAL' WHEN recent AND detected AND down THEN 'FALL_CANDIDATE' WHEN motion THEN 'FALLING' WHEN live AND NOT recent AND detected THEN 'NORMAL'
   WHEN live AND NOT recent AND away >= 5 THEN 'UNKNOWN' END AS mark FROM crecent_t""",
)
_isl = "(PARTITION BY session_id, isl ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
cte(
    "cwalk_t",
    f"""SELECT *, s - LEAST(0, MIN(s) OVER {_isl}) AS cand, COALESCE(LAST_VALUE(mark IGNORE NULLS) OVER {_up}, 'UNKNOWN') AS open_state FROM (
 SELECT *, SUM(CASE WHEN NOT recent OR NOT detected THEN 0 WHEN lying THEN 1 ELSE -1 END) OVER {_isl} AS s FROM cmark_t)""",
)
cte(
    "cstates_t",
    """SELECT w.session_id, frame_idx, CASE WHEN fallen THEN 'FALLEN' ELSE open_state END AS state, fallen AS fall_latched, NOT COALESCE(frame_idx >= t, FALSE) AS calibrating, detected,
  CASE WHEN frame_idx >= t THEN LEAST(speed/0.55E0, 2.0E0)*0.35E0 + LEAST(fdrop/0.3E0, 2.0E0)*0.25E0 + LEAST(angle/48, 2.0E0)*0.15E0 + LEAST(aspect/0.85E0, 2.0E0)*0.1E0
   + LEAST(GREATEST(low_hip, 0)/0.28E0, 2.0E0)*0.15E0 ELSE 0 END AS score, speed AS downward_speed, fdrop AS drop_, angle AS torso_angle, aspect AS bbox_aspect, low_hip
FROM (SELECT w.*, COALESCE(frame_idx >= f, FALSE) AS fallen FROM cwalk_t w JOIN (SELECT session_id, MIN(frame_idx) FILTER (recent AND (cand >= 5 OR gone >= 5)) AS f FROM cwalk_t GROUP BY 1) x
  ON x.session_id = w.session_id) w""",
)
LIVE_SQL = "SELECT session_id, frame_idx, state, fall_latched, calibrating, detected, " + ", ".join(
    f"ROUND({'drop_' if c == 'drop' else c}, 6) + 0.0E0 AS \"{c}\"" for c in OUT
) + " FROM cstates_t"


@query("stream_fall_detector", LIVE_SQL)
def _(spark, sf):
    return rounded(drained(detector.detect_stream(replay(live_frames(spark, sf), "frames"), LIVE), "states"), *OUT)


@query("causal_fall_states", LIVE_SQL)
def _(spark, sf):
    return rounded(causal.causal_fall_states(frame_geometry(fx.keypoints(spark, sf)), fx.FPS, fx.HEIGHT), *OUT)


@query("stream_calibration_fps")
def _(spark, sf):
    live = detector.LiveConfig(frame_height=fx.HEIGHT, fps=None)
    frames = live_frames(spark, sf).withColumn("seconds", F.col("frame_idx") / (5.0 + F.col("session_id") % 10))
    ends = frames.groupBy("session_id").agg(F.max("frame_idx").alias("frame_idx"))
    ends = ends.select("session_id", "frame_idx", *[F.lit("end" if c == "control" else None).cast(t).alias(c) for c, t in frames.dtypes if c not in ("session_id", "frame_idx")])
    return drained(detector.detect_stream(replay(frames.unionByName(ends), "probe"), live), "probed")


@query("stream_alarm_control")
def _(spark, sf):
    frames = live_frames(spark, sf)
    empty = {c: F.lit(None).cast(t) for c, t in frames.dtypes if c not in ("session_id", "frame_idx", "control")}
    orders = fx.frames(spark, sf).where("frame_idx IN (30, 45)").select("session_id", "frame_idx").withColumns(
        {**empty, "control": F.when(F.col("frame_idx") == 30, "force").otherwise("reset")}
    )
    both = replay(frames, "frames").unionByName(replay(orders, "orders"))
    return drained(detector.detect_stream(both, LIVE), "controlled")


@query("stream_reorder", """SELECT session_id, event_id AS payload_id, frame_idx, CAST(v AS INTEGER) AS view_idx,
  ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame_idx, v) - 1 AS seq, FALSE AS late FROM frames_t JOIN (SELECT UNNEST(RANGE(4)) AS v) ON v <= event_id % 4""")
def _(spark, sf):
    views = fx.frames(spark, sf).select(
        "session_id", "frame_idx", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int"))).alias("view_idx"),
        (F.col("event_id") % 4 + 1).cast("int").alias("n_views"), F.col("event_id").cast("string").alias("payload"),
    ).orderBy(F.xxhash64("payload", "view_idx"))
    ends = views.select("session_id").distinct().select("session_id", *[F.lit(None).cast(t).alias(c) for c, t in views.dtypes if c != "session_id"])
    views = views.unionByName(ends)
    out = drained(flows.reorder_stream(replay(views, "shuffled")), "ordered")
    return out.select("session_id", F.col("payload").cast("bigint").alias("payload_id"), "frame_idx", "view_idx", "seq", "late")


@query("stream_assemble_views", """SELECT session_id, frame_idx, CAST(event_id % 4 + 1 AS INTEGER) AS n_views, STRING_AGG(v::VARCHAR, ',' ORDER BY v) AS views
FROM frames_t JOIN (SELECT UNNEST(RANGE(4)) AS v) ON v <= event_id % 4 WHERE (event_id*(v + 1)) % 11 <> 0
GROUP BY ALL HAVING COUNT(*) = event_id % 4 + 1""")
def _(spark, sf):
    e = F.col("event_id")
    views = fx.frames(spark, sf).select(
        "session_id", "frame_idx", F.col("ts").cast("timestamp").alias("ts"), (e % 4 + 1).cast("int").alias("n_views"), e,
        F.explode(F.sequence(F.lit(0), (e % 4).cast("int"))).alias("view_idx"),
    ).where((e * (F.col("view_idx") + 1)) % 11 != 0)
    out = drained(flows.assemble_views_stream(replay(flows.with_end(views, "1 HOUR"), "views")), "frames")
    return out.select("session_id", "frame_idx", "n_views", F.array_join(F.transform("views", lambda v: v.cast("string")), ",").alias("views"))


@query("stream_status_events", """WITH RECURSIVE w AS (
 SELECT session_id, frame_idx, state, fall_latched, frame_idx/10.0E0 AS seconds, frame_idx/10.0E0 AS told, 'state_change' AS reason FROM cstates_t WHERE frame_idx = 0
 UNION ALL SELECT c.session_id, c.frame_idx, c.state, c.fall_latched, c.frame_idx/10.0E0,
  CASE WHEN c.state <> w.state OR c.frame_idx/10.0E0 - w.told >= 1 THEN c.frame_idx/10.0E0 ELSE w.told END,
  CASE WHEN c.state <> w.state THEN 'state_change' WHEN c.frame_idx/10.0E0 - w.told >= 1 THEN 'heartbeat' END
 FROM w JOIN cstates_t c ON c.session_id = w.session_id AND c.frame_idx = w.frame_idx + 1)
SELECT session_id, frame_idx, seconds, state, state = 'FALLEN' AS fall_detected, fall_latched, reason FROM w WHERE reason IS NOT NULL""")
def _(spark, sf):
    states = causal.causal_fall_states(frame_geometry(fx.keypoints(spark, sf)), fx.FPS, fx.HEIGHT)
    timed = states.select("session_id", "frame_idx", (F.col("frame_idx") / fx.FPS).alias("seconds"), "state", "fall_latched")
    return drained(flows.status_events(replay(timed, "decisions")), "status")


def windows(spark, sf, kind: str, length: str, slide_or_gap: str):
    events = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = drained(flows.status_windows(replay(flows.with_end(events, "30 DAYS"), "events"), kind, length, slide_or_gap), "windows")
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), "mean_value")


@query("stream_session_windows", """SELECT user_id AS session_id, s AS "start", s + INTERVAL 6 HOURS AS "end", COUNT(*) AS events, ROUND(AVG(value), 6) AS mean_value
FROM (SELECT *, TIME_BUCKET(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS s FROM events) GROUP BY ALL""")
def _(spark, sf):
    return windows(spark, sf, "tumbling", "6 hours", "")


@query("stream_sliding_windows", """SELECT user_id AS session_id, s AS "start", s + INTERVAL 6 HOURS AS "end", COUNT(*) AS events, ROUND(AVG(value), 6) AS mean_value
FROM (SELECT *, TIME_BUCKET(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 2 HOURS AS s FROM events, (SELECT UNNEST([0, 1, 2]) AS k)) GROUP BY ALL""")
def _(spark, sf):
    return windows(spark, sf, "sliding", "6 hours", "2 hours")


@query("stream_gap_windows", """SELECT session_id, MIN(ts) AS "start", MAX(ts) + INTERVAL 8 HOURS AS "end", COUNT(*) AS events, ROUND(AVG(value), 6) AS mean_value FROM (
 SELECT *, SUM(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (
  SELECT user_id AS session_id, ts, event_id, value, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 8 HOURS THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY session_id, n""")
def _(spark, sf):
    return windows(spark, sf, "session", "", "8 hours")

"""Queries over multi-person frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import people as P
from . import fixtures as fx
from .registry import cte, query, rounded

BOX = ["box_x", "box_y", "box_w", "box_h"]


def _r(*names, d=6):
    return ", ".join(f"ROUND({n}, {d}) + 0.0E0 AS {n}" for n in names)


def seen(spark, sf):
    """People with at least one joint: a fully missing frame has nobody."""
    return fx.people(spark, sf).where("c > 0")


def frame_keys(spark, sf):
    return fx.frames(spark, sf).select("session_id", "frame_idx")


cte("seen_t", "SELECT * FROM people_t WHERE c > 0")
cte(
    "box_t",
    """SELECT session_id, frame_idx, person_idx, COALESCE(MIN(x), 0) AS box_x, COALESCE(MIN(y), 0) AS box_y,
  COALESCE(MAX(x) - MIN(x), 0) AS box_w, COALESCE(MAX(y) - MIN(y), 0) AS box_h
FROM (SELECT session_id, frame_idx, person_idx, CASE WHEN c > 0.6E0 AND joint < 15 THEN x END AS x,
  CASE WHEN c > 0.6E0 AND joint < 15 THEN y END AS y FROM people_t) GROUP BY ALL""",
)


@query(
    "select_person_conf",
    """WITH m AS (SELECT session_id, frame_idx, person_idx, ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx
   ORDER BY AVG(c) DESC, person_idx) AS rn FROM seen_t GROUP BY session_id, frame_idx, person_idx),
 k AS (SELECT s.* FROM seen_t s JOIN m ON s.session_id = m.session_id AND s.frame_idx = m.frame_idx AND s.person_idx = m.person_idx AND rn = 1)
SELECT f.session_id, f.frame_idx, CAST(j AS INTEGER) AS joint, ROUND(x, 6) AS x, ROUND(y, 6) AS y, ROUND(COALESCE(c, 0), 6) AS c
FROM frames_t f CROSS JOIN (SELECT UNNEST(RANGE(25)) AS j) LEFT JOIN k ON f.session_id = k.session_id AND f.frame_idx = k.frame_idx AND joint = j""",
)
def _(spark, sf):
    return rounded(P.select_person_conf(seen(spark, sf), frame_keys(spark, sf), 25), "x", "y", "c")


@query(
    "select_person_size",
    """SELECT session_id, frame_idx, person_idx, ROUND(s, 6) AS size_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx ORDER BY s DESC, person_idx) AS rn FROM (
   SELECT session_id, frame_idx, person_idx, GREATEST(MAX(x) - MIN(x), 1)*GREATEST(MAX(y) - MIN(y), 1)*AVG(c)
     *AVG(CASE WHEN c > 0.2E0 THEN 1.0E0 ELSE 0 END) AS s FROM seen_t GROUP BY ALL)) WHERE rn = 1""",
)
def _(spark, sf):
    return rounded(P.select_person_size(seen(spark, sf)), "size_score")


_map = ",".join(f"({s},{d})" for s, d in P.PARTS_17_TO_25.items()) + ",(5,1),(6,1),(11,8),(12,8)"


@query(
    "remap_skeleton",
    f"""WITH m AS (SELECT * FROM (VALUES {_map}) AS t(src, dst)),
 p AS (SELECT DISTINCT session_id, frame_idx, person_idx FROM people_t WHERE joint = 0),
 w AS (SELECT session_id, frame_idx, person_idx, dst, SUM(x*c)/SUM(c) AS x, SUM(y*c)/SUM(c) AS y, AVG(c) AS c
   FROM people_t JOIN m ON joint = src WHERE c > 0 AND x IS NOT NULL GROUP BY ALL)
SELECT p.session_id, p.frame_idx, p.person_idx, CAST(j AS INTEGER) AS joint, ROUND(x, 6) AS x, ROUND(y, 6) AS y, ROUND(COALESCE(c, 0), 6) AS c
FROM p CROSS JOIN (SELECT UNNEST(RANGE(25)) AS j) LEFT JOIN w ON w.session_id = p.session_id AND w.frame_idx = p.frame_idx
  AND w.person_idx = p.person_idx AND dst = j""",
)
def _(spark, sf):
    # the figure's first 17 joints stand for the 17-part source
    return rounded(P.remap_skeleton(fx.people(spark, sf).where("joint < 17")), "x", "y", "c")


@query(
    "frame_range",
    "SELECT session_id, frame_idx, event_id FROM frames_t WHERE frame_idx BETWEEN 10 AND 40 AND (frame_idx - 10) % 3 = 0",
)
def _(spark, sf):
    return P.frame_range(fx.frames(spark, sf), 10, 40, 3).select("session_id", "frame_idx", "event_id")


_modes = ", ".join(f"'{m}'" for m in P.SCALE_MODES)


@query(
    "scale_keypoints",
    f"""SELECT session_id, frame_idx, joint, mode, ROUND(x*sx + o, 6) + 0.0E0 AS x, ROUND(y*sy + o, 6) + 0.0E0 AS y FROM (
 SELECT *, CASE mode WHEN 'output' THEN 1.5E0 WHEN 'net_output' THEN 1/4.0E0 WHEN 'unit' THEN 1/639.0E0 WHEN 'unit_fixed' THEN 1/639.0E0
   WHEN 'signed' THEN 2/639.0E0 WHEN 'signed_fixed' THEN 2/639.0E0 ELSE 1.0E0 END AS sx,
  CASE mode WHEN 'output' THEN 1.5E0 WHEN 'net_output' THEN 1/4.0E0 WHEN 'unit' THEN 1/479.0E0 WHEN 'unit_fixed' THEN 1/639.0E0
   WHEN 'signed' THEN 2/479.0E0 WHEN 'signed_fixed' THEN 2/639.0E0 ELSE 1.0E0 END AS sy,
  CASE WHEN mode IN ('signed', 'signed_fixed') THEN -1.0E0 ELSE 0.0E0 END AS o
 FROM (SELECT *, ([{_modes}])[session_id % 7 + 1] AS mode FROM kp_t))""",
)
def _(spark, sf):
    modes = F.array(*[F.lit(m) for m in P.SCALE_MODES])
    kp = fx.keypoints(spark, sf).select(
        "session_id", "frame_idx", "joint", "x", "y",
        F.element_at(modes, (F.col("session_id") % 7 + 1).cast("int")).alias("mode"),
        F.lit(fx.WIDTH).alias("w"), F.lit(fx.HEIGHT).alias("h"),
    )
    return rounded(P.scale_keypoints(kp, "mode", "w", "h", 1.5, 4.0).drop("w", "h"), "x", "y")


@query("scale_keypoints_uniform", "SELECT session_id, frame_idx, joint, ROUND(x*0.25E0, 6) AS x, ROUND(y*0.25E0, 6) + 0.0E0 AS y FROM kp_t")
def _(spark, sf):
    return rounded(P.scale_uniform(fx.keypoints(spark, sf).drop("c"), 0.25), "x", "y")


@query("person_box", f"SELECT session_id, frame_idx, person_idx, {_r(*BOX)} FROM box_t")
def _(spark, sf):
    return rounded(P.person_box(fx.people(spark, sf), 0.6, 0, 15), *BOX)


cte(
    "stats_t",
    """SELECT session_id, frame_idx, person_idx, AVG(c) AS avg_score,
  COALESCE((MAX(x) FILTER (c > 0.05E0) - MIN(x) FILTER (c > 0.05E0))*(MAX(y) FILTER (c > 0.05E0) - MIN(y) FILTER (c > 0.05E0)), 0) AS area,
  COUNT(*) FILTER (c >= 0.05E0) AS n_joints,
  SQRT(POWER(MAX(x) FILTER (joint = 1) - MAX(x) FILTER (joint = 8), 2) + POWER(MAX(y) FILTER (joint = 1) - MAX(y) FILTER (joint = 8), 2)) AS limb
FROM people_t GROUP BY session_id, frame_idx, person_idx""",
)


@query("person_stats", f"SELECT session_id, frame_idx, person_idx, n_joints, {_r('avg_score', 'area', 'limb')} FROM stats_t")
def _(spark, sf):
    return rounded(P.person_stats(fx.people(spark, sf), 0.05, (1, 8)), "avg_score", "area", "limb")


@query(
    "biggest_person",
    """SELECT session_id, frame_idx, person_idx FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx
  ORDER BY box_w*box_h DESC, person_idx) AS rn FROM box_t) WHERE rn = 1""",
)
def _(spark, sf):
    return P.best_person(P.person_box(fx.people(spark, sf), 0.6, 0, 15), F.col("box_w") * F.col("box_h"))


def _joints(js):
    return ", ".join(f"MAX({a}) FILTER (joint = {j}) AS {a}{j}" for j in js for a in "xyc")


def _d(a, b):
    return f"SQRT(POWER(x{a} - x{b}, 2) + POWER(y{a} - y{b}, 2))"


def _hand(side, js):
    w, e, s = js
    ok = f"c{w} > 0.03E0 AND c{e} > 0.03E0 AND c{s} > 0.03E0"
    size = f"1.5E0*GREATEST({_d(w, e)}, 0.9E0*{_d(e, s)})"
    c = lambda a: f"COALESCE(CASE WHEN {ok} THEN {a}{w} + 0.33E0*({a}{w} - {a}{e}) - {size}/2 END, 0)"
    z = f"COALESCE(CASE WHEN {ok} THEN {size} END, 0)"
    return f"SELECT session_id, frame_idx, person_idx, '{side}' AS side, {c('x')} AS box_x, {c('y')} AS box_y, {z} AS box_w, {z} AS box_h FROM arms_t"


cte("arms_t", f"SELECT session_id, frame_idx, person_idx, {_joints([2, 3, 4, 5, 6, 7])} FROM people_t GROUP BY ALL")
cte("hands_t", f"{_hand('left', P.L_HAND)} UNION ALL {_hand('right', P.R_HAND)}")


@query("hand_boxes", f"SELECT session_id, frame_idx, person_idx, side, {_r(*BOX)} FROM hands_t")
def _(spark, sf):
    return rounded(P.hand_boxes(fx.people(spark, sf)), *BOX)


def _face_sql():
    j = P.FACE
    d = lambda a, b: _d(j[a], j[b])

    def center(a):
        g = {n: f"{a}{p}" for n, p in j.items()}
        return f"""CASE WHEN neck AND nose THEN CASE WHEN prof AND leye THEN ({g['leye']} + {g['lear']} + {g['nose']})/3
    WHEN prof THEN ({g['reye']} + {g['rear']} + {g['nose']})/3 ELSE ({g['neck']} + {g['nose']})/2 END ELSE 0 END
   + CASE WHEN leye AND reye THEN ({g['leye']} + {g['reye']})/2 ELSE 0 END + CASE WHEN lear AND rear THEN ({g['lear']} + {g['rear']})/2 ELSE 0 END"""

    size = f"""CASE WHEN neck AND nose THEN CASE WHEN prof AND leye THEN 0.85E0*({d('nose', 'leye')} + {d('nose', 'lear')} + {d('neck', 'nose')})
    WHEN prof THEN 0.85E0*({d('nose', 'reye')} + {d('nose', 'rear')} + {d('neck', 'nose')}) ELSE 2*{d('neck', 'nose')} END ELSE 0 END
   + CASE WHEN leye AND reye THEN 3*{d('leye', 'reye')} ELSE 0 END + CASE WHEN lear AND rear THEN 2*{d('lear', 'rear')} ELSE 0 END"""
    flags = ", ".join(f"COALESCE(c{p} > 0.25E0, FALSE) AS {n}" for n, p in j.items())
    return f"""SELECT session_id, frame_idx, person_idx, sx/n - size/n/2 AS box_x, sy/n - size/n/2 AS box_y, size/n AS box_w, size/n AS box_h FROM (
  SELECT *, {center('x')} AS sx, {center('y')} AS sy, {size} AS size,
   GREATEST(CAST(neck AND nose AS INTEGER) + CAST(leye AND reye AS INTEGER) + CAST(lear AND rear AS INTEGER), 1) AS n FROM (
   SELECT *, (leye = lear) AND (reye = rear) AND (leye <> reye) AS prof FROM (
    SELECT *, {flags} FROM (SELECT session_id, frame_idx, person_idx, {_joints(sorted(j.values()))} FROM people_t GROUP BY ALL))))"""


cte("faces_t", _face_sql())


@query("face_boxes", f"SELECT session_id, frame_idx, person_idx, {_r(*BOX)} FROM faces_t")
def _(spark, sf):
    return rounded(P.face_boxes(fx.people(spark, sf)), *BOX)


@query(
    "recenter_box",
    f"""SELECT session_id, frame_idx, person_idx, {_r(*BOX)} FROM (
 SELECT c.session_id, c.frame_idx, c.person_idx, c.box_x + c.box_w/2 - s/2 AS box_x, c.box_y + c.box_h/2 - s/2 AS box_y, s AS box_w, s AS box_h FROM (
  SELECT f.*, GREATEST(f.box_w, 0.85E0*GREATEST(COALESCE(p.box_w, 0), COALESCE(p.box_h, 0))) AS s FROM faces_t f
  LEFT JOIN faces_t p ON p.session_id = f.session_id AND p.person_idx = f.person_idx AND p.frame_idx = f.frame_idx - 1
  WHERE LEAST(f.box_w, f.box_h) > 40) c)""",
)
def _(spark, sf):
    faces = P.face_boxes(fx.people(spark, sf))
    prior = faces.select(
        "session_id", (F.col("frame_idx") + 1).alias("frame_idx"), "person_idx", F.greatest("box_w", "box_h").alias("_prev")
    )
    big = faces.where(F.least("box_w", "box_h") > 40).join(prior, ["session_id", "frame_idx", "person_idx"], "left")
    size = F.greatest(F.col("box_w"), 0.85 * F.coalesce("_prev", F.lit(0.0)))
    sized = big.withColumn("_s", size)
    return rounded(P.recenter_box(sized, F.col("_s"), F.col("_s")).drop("_s", "_prev"), *BOX)


@query(
    "backproject_affine",
    """SELECT k.session_id, k.frame_idx, k.person_idx, side, joint, ROUND(box_w/368*x + 0.1E0*y + box_x, 6) + 0.0E0 AS x,
  ROUND(box_h/368*y + box_y, 6) + 0.0E0 AS y FROM people_t k JOIN hands_t h ON h.session_id = k.session_id AND h.frame_idx = k.frame_idx
   AND h.person_idx = k.person_idx AND box_w > 0""",
)
def _(spark, sf):
    ppl = fx.people(spark, sf)
    zero = F.lit(0.0)
    affine = P.hand_boxes(ppl).where("box_w > 0").select(
        *P.PERSON, "side", (F.col("box_w") / 368).alias("m00"), F.lit(0.1).alias("m01"), F.col("box_x").alias("m02"),
        zero.alias("m10"), (F.col("box_h") / 368).alias("m11"), F.col("box_y").alias("m12"),
    )
    return rounded(P.backproject_affine(ppl.drop("c"), affine, P.PERSON), "x", "y")


@query(
    "infer_frame_size",
    """SELECT session_id, COALESCE(GREATEST(CAST(FLOOR(MAX(x)) AS BIGINT) + 1, 1), 640) AS frame_width,
  COALESCE(GREATEST(CAST(FLOOR(MAX(y)) AS BIGINT) + 1, 1), 480) AS frame_height FROM kp_t GROUP BY session_id""",
)
def _(spark, sf):
    return P.infer_frame_size(fx.keypoints(spark, sf))


@query(
    "usable_sequences",
    "SELECT session_id, frame_idx, event_id FROM frames_t WHERE session_id IN (SELECT session_id FROM frames_t GROUP BY 1 HAVING COUNT(*) >= 65)",
)
def _(spark, sf):
    return P.usable_sequences(fx.frames(spark, sf).select("session_id", "frame_idx", "event_id"), 65)


@query(
    "progress_sample",
    """SELECT f.session_id, frame_idx, n_frames FROM frames_t f JOIN sessions_t s ON f.session_id = s.session_id
WHERE frame_idx = 0 OR frame_idx >= n_frames - 1 OR (frame_idx + 1) % CAST(FLOOR(0.1E0*n_frames + 0.5E0) AS BIGINT) = 0""",
)
def _(spark, sf):
    out = P.progress_sample(fx.frames(spark, sf), fx.sessions(spark, sf), 0.1)
    return out.select("session_id", "frame_idx", "n_frames")


@query(
    "person_iou",
    """SELECT session_id, frame_idx, person_a, person_b, ROUND(iou, 6) AS iou FROM (
 SELECT a.session_id, a.frame_idx, a.person_idx AS person_a, b.person_idx AS person_b, iw*ih/(a.box_w*a.box_h + b.box_w*b.box_h - iw*ih) AS iou
 FROM box_t a JOIN box_t b ON a.session_id = b.session_id AND a.frame_idx = b.frame_idx AND a.person_idx < b.person_idx,
  LATERAL (SELECT LEAST(a.box_x + a.box_w, b.box_x + b.box_w) - GREATEST(a.box_x, b.box_x) AS iw, LEAST(a.box_y + a.box_h, b.box_y + b.box_h) - GREATEST(a.box_y, b.box_y) AS ih)
 WHERE iw > 0 AND ih > 0)""",
)
def _(spark, sf):
    return rounded(P.person_iou(P.person_box(fx.people(spark, sf), 0.6, 0, 15)), "iou")


@query(
    "person_distance",
    """SELECT a.session_id, a.frame_idx, a.person_idx, ROUND(AVG(CASE WHEN a.c >= 0.7E0 AND b.c >= 0.7E0
   THEN SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2)) END), 6) AS distance
FROM people_t a JOIN people_t b ON a.session_id = b.session_id AND a.frame_idx = b.frame_idx + 1 AND a.person_idx = b.person_idx
 AND a.joint = b.joint GROUP BY ALL""",
)
def _(spark, sf):
    ppl, before = fx.dealt_people(spark, sf), fx.dealt_people(spark, sf, 1)
    return rounded(P.person_distance(ppl, before, [*P.PERSON, "_deal"], 0.7).drop("_deal"), "distance")


cte(
    "handkp_t",
    """SELECT session_id, frame_idx, person_idx, CASE WHEN joint IN (5, 6, 7) THEN 'left' ELSE 'right' END AS side, x, y, c
FROM people_t WHERE joint BETWEEN 2 AND 7""",
)


@query(
    "track_hand_boxes",
    f"""WITH prev AS (SELECT session_id, frame_idx + 1 AS frame_idx, person_idx, side, MIN(x) FILTER (c > 0.25E0) AS box_x, MIN(y) FILTER (c > 0.25E0) AS box_y,
   MAX(x) FILTER (c > 0.25E0) - MIN(x) FILTER (c > 0.25E0) AS box_w, MAX(y) FILTER (c > 0.25E0) - MIN(y) FILTER (c > 0.25E0) AS box_h
  FROM handkp_t GROUP BY session_id, frame_idx, person_idx, side HAVING AVG(c) > 0.66667E0),
 pairs AS (SELECT h.session_id, h.frame_idx, h.person_idx, h.side, p.box_x AS px, p.box_y AS py, p.box_w AS pw, p.box_h AS ph,
   ROW_NUMBER() OVER (PARTITION BY h.session_id, h.frame_idx, h.person_idx, h.side ORDER BY
     LEAST(1, iw*ih/LEAST(h.box_w*h.box_h, p.box_w*p.box_h)) DESC, p.person_idx) AS rn
  FROM hands_t h JOIN prev p ON h.session_id = p.session_id AND h.frame_idx = p.frame_idx AND h.side = p.side,
   LATERAL (SELECT 1 + LEAST(h.box_x + h.box_w, p.box_x + p.box_w) - GREATEST(h.box_x, p.box_x) AS iw, 1 + LEAST(h.box_y + h.box_h, p.box_y + p.box_h) - GREATEST(h.box_y, p.box_y) AS ih)
  WHERE h.box_w*h.box_h > 0 AND p.box_w*p.box_h > 0 AND iw > 0 AND ih > 0)
SELECT session_id, frame_idx, person_idx, side, tracked, {_r(*BOX)} FROM (
 SELECT h.session_id, h.frame_idx, h.person_idx, h.side, p.px IS NOT NULL AS tracked,
  COALESCE(0.5E0*(box_x + px + 0.5E0*(box_w + pw) - nw), box_x) AS box_x, COALESCE(0.5E0*(box_y + py + 0.5E0*(box_h + pw) - nw), box_y) AS box_y,
  COALESCE(nw, box_w) AS box_w, COALESCE(nw, box_h) AS box_h
 FROM hands_t h LEFT JOIN (SELECT * FROM pairs WHERE rn = 1) p ON h.session_id = p.session_id AND h.frame_idx = p.frame_idx AND h.person_idx = p.person_idx AND h.side = p.side,
  LATERAL (SELECT GREATEST((box_w*2 + pw)*0.5E0, (box_h*2 + pw)*0.5E0) + 0*pw AS nw))""",
)
def _(spark, sf):
    ppl = fx.people(spark, sf)
    side = F.when(F.col("joint").isin(5, 6, 7), "left").otherwise("right")
    hands = ppl.where(F.col("joint").between(2, 7)).withColumn("side", side)
    return rounded(P.track_hand_boxes(P.hand_boxes(ppl), P.confident_hands(hands)), *BOX)


_before = "SELECT *, LAG({'frame_idx': frame_idx, 'x': x, 'y': y, 'c': c}) OVER (PARTITION BY session_id, person_idx, joint ORDER BY frame_idx) AS old FROM people_t"


@query(
    "merge_best_keypoint",
    f"""SELECT session_id, frame_idx, person_idx, joint, t AS replaced, {', '.join(f'ROUND(CASE WHEN t THEN old.{v} ELSE {v} END, 6) + 0.0E0 AS {v}' for v in 'xyc')} FROM (
 SELECT *, COALESCE(old.frame_idx = frame_idx - 1 AND old.c - c > 0.05E0, FALSE) AS t FROM ({_before}))""",
)
def _(spark, sf):
    ppl, before = fx.dealt_people(spark, sf), fx.dealt_people(spark, sf, 1)
    return rounded(P.merge_best_keypoint(ppl, before, [*P.PERSON, "joint", "_deal"]).drop("_deal"), "x", "y", "c")


@query(
    "blend_tracked",
    f"""SELECT session_id, frame_idx, person_idx, joint, c >= 0.6E0 AS active, {', '.join(
        f"ROUND(CASE WHEN old.frame_idx IS NULL THEN {v} WHEN c < 0.6E0 THEN p{v} WHEN d < 5 THEN p{v} WHEN d < 10 THEN FLOOR((p{v} + o{v})/2.0E0 + 0.5E0) ELSE o{v} END, 6) + 0.0E0 AS {v}" for v in 'xy')}
FROM (SELECT *, SQRT(POWER(px - ox, 2) + POWER(py - oy, 2)) AS d FROM (
 SELECT * REPLACE (CASE WHEN old.frame_idx = frame_idx - 1 THEN old END AS old), ROUND_EVEN(CASE WHEN old.frame_idx = frame_idx - 1 THEN old.x END, 0) AS px,
  ROUND_EVEN(CASE WHEN old.frame_idx = frame_idx - 1 THEN old.y END, 0) AS py, FLOOR(x + 0.5E0) AS ox, FLOOR(y + 0.5E0) AS oy FROM ({_before})))""",
)
def _(spark, sf):
    ppl, before = fx.dealt_people(spark, sf), fx.dealt_people(spark, sf, 1)
    out = P.blend_tracked(before, ppl, [*P.PERSON, "joint", "_deal"], 0.6).drop("c", "_deal")
    return rounded(out, "x", "y")


@query(
    "keep_top_people",
    """SELECT session_id, frame_idx, person_idx, CAST(rn AS INTEGER) AS rank, ROUND(rs, 6) AS rank_score FROM (
 SELECT *, avg_score*SQRT(area) AS rs, ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx ORDER BY avg_score*SQRT(area) DESC, person_idx) AS rn
 FROM stats_t) WHERE rn <= 2""",
)
def _(spark, sf):
    stats = P.person_stats(fx.people(spark, sf), 0.05, (1, 8)).withColumnRenamed("avg_score", "score")
    top = P.keep_top_people(stats, 2).select(*P.PERSON, "rank", "rank_score")
    return rounded(top, "rank_score")

"""Raster, limb and assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import candidates as G, people as P
from . import fixtures as fx
from .registry import cte, query, rounded, table

SIZE = 8
PAIRS = ((0, 1), (0, 2), (1, 3))


def _r(*names, d=6):
    return ", ".join(f"ROUND({n}, {d}) + 0.0E0 AS {n}" for n in names)


_n8 = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
cte(
    "peaks_t",
    f"""SELECT session_id, frame_idx, part, cy, cx, v, ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx, part ORDER BY cy, cx) - 1 AS peak_idx FROM (
 SELECT g.session_id, g.frame_idx, g.part, g.cy, g.cx, g.v,
  BOOL_AND(g.v > n.v) FILTER (n.v IS NOT NULL) AS strict, BOOL_AND(g.v >= n.v) FILTER (n.v IS NOT NULL) AS loose
 FROM grid_t g CROSS JOIN (VALUES {','.join(str(o) for o in _n8)}) o(dy, dx)
 LEFT JOIN grid_t n ON n.session_id = g.session_id AND n.frame_idx = g.frame_idx AND n.cy = g.cy + dy AND n.cx = g.cx + dx GROUP BY ALL)
WHERE v > 0.1E0 AND CASE WHEN cx BETWEEN 2 AND 5 AND cy BETWEEN 2 AND 5 THEN strict WHEN cx IN (1, 6) OR cy IN (1, 6) THEN loose ELSE FALSE END
QUALIFY peak_idx < 4""",
)


def peaks(spark, sf):
    return G.grid_peaks(fx.grid(spark, sf), SIZE, SIZE, 0.1, 4)


@query("grid_peaks", "SELECT session_id, frame_idx, part, cy, cx, CAST(peak_idx AS INTEGER) AS peak_idx, ROUND(v, 6) AS v FROM peaks_t")
def _(spark, sf):
    return rounded(peaks(spark, sf), "v")


@query("refine_peaks", """SELECT p.session_id, p.frame_idx, p.part, CAST(peak_idx AS INTEGER) AS peak_idx, ROUND(p.v, 6) AS score, ROUND(SUM(g.cx*g.v)/SUM(g.v) + 0.5E0, 6) AS x,
  ROUND(SUM(g.cy*g.v)/SUM(g.v) + 0.5E0, 6) AS y
FROM peaks_t p JOIN grid_t g ON g.session_id = p.session_id AND g.frame_idx = p.frame_idx AND ABS(g.cy - p.cy) <= 3 AND ABS(g.cx - p.cx) <= 3 AND g.v > 0 GROUP BY p.session_id, p.frame_idx, p.part, peak_idx, p.v""")
def _(spark, sf):
    return rounded(G.refine_peaks(peaks(spark, sf), fx.grid(spark, sf)), "score", "x", "y")


@query("part_argmax", """SELECT session_id, frame_idx, part, cy, cx, ROUND(v, 6) AS score FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx, part ORDER BY v DESC, cy, cx) AS rn FROM grid_t) WHERE rn = 1""")
def _(spark, sf):
    return rounded(G.part_argmax(fx.grid(spark, sf)), "score")


@query("merge_scales", "SELECT session_id, frame_idx // 2 AS frame, cy, cx, ROUND(AVG(v), 6) + 0.0E0 AS v FROM grid_t GROUP BY ALL")
def _(spark, sf):
    g = fx.grid(spark, sf).withColumn("frame", F.floor(F.col("frame_idx") / 2))
    return rounded(G.merge_scales(g, ["session_id", "frame"]), "v")


@query("best_of_scales", """SELECT session_id, frame_idx, person_idx AS best_scale, ROUND(m, 6) AS mean_c FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx ORDER BY m DESC, person_idx) AS rn FROM (
  SELECT session_id, frame_idx, person_idx, AVG(c) AS m FROM people_t GROUP BY ALL)) WHERE rn = 1""")
def _(spark, sf):
    return rounded(G.best_of_scales(fx.people(spark, sf), ["session_id", "frame_idx"], "person_idx"), "mean_c")


@query("scale_grid", """SELECT session_id, frame_idx, cy, cx, ROUND(2*LEAST(GREATEST(v, 0), 1) - 1, 6) + 0.0E0 AS part_signed, FLOOR(255*LEAST(GREATEST(v, 0), 1) + 0.5E0) AS part_byte,
  ROUND(0.5E0*(LEAST(GREATEST(v, -1), 1) + 1), 6) AS field_unit, FLOOR(128.5E0*LEAST(GREATEST(v, -1), 1) + 128.5E0 + 0.5E0) AS field_byte FROM grid_t""")
def _(spark, sf):
    g = fx.grid(spark, sf).select("session_id", "frame_idx", "cy", "cx", F.col("v").alias("raw"), "v")
    for name, mode, kind in (("part_signed", "signed", "part"), ("part_byte", "byte", "part"), ("field_unit", "unit", "field"), ("field_byte", "byte", "field")):
        g = G.scale_grid(g.withColumn("v", F.col("raw")), mode, kind).withColumn(name, F.col("v"))
    return rounded(g.drop("v", "raw"), "part_signed", "field_unit")


# Candidates of an embedding frame: bright cells, the quadrant is the part.  The field of every
# limb is the raster and its transpose.
cte(
    "qcand_t",
    """SELECT session_id, frame_idx, (cy // 4)*2 + cx // 4 AS part, CAST(ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx, (cy // 4)*2 + cx // 4 ORDER BY cy, cx) - 1 AS INTEGER) AS cand_idx,
  CAST(cx AS DOUBLE) AS x, CAST(cy AS DOUBLE) AS y, v AS score FROM grid_t WHERE v > 0.12E0""",
)
cte(
    "limb_t",
    f"""SELECT session_id, frame_idx, pair_idx, cand_a, cand_b, a_score, b_score, CASE WHEN len <= 1E-6 THEN 0 WHEN good/CAST(n AS DOUBLE) > 0.4E0 THEN s/good
  WHEN len < SQRT(64)/150 THEN 0.05E0 + 1E-6 ELSE 0 END AS score FROM (
 SELECT p.session_id, p.frame_idx, pair_idx, cand_a, cand_b, a_score, b_score, len, n, SUM(d) FILTER (d > 0.05E0) AS s, COUNT(*) FILTER (d > 0.05E0) AS good FROM (
  SELECT q.*, (dx/len)*gx.v + (dy/len)*gy.v AS d FROM (
   SELECT *, CAST(LEAST(GREATEST(FLOOR(ax + k*(dx/n) + 0.5E0), 0), 7) AS INTEGER) AS mx, CAST(LEAST(GREATEST(FLOOR(ay + k*(dy/n) + 0.5E0), 0), 7) AS INTEGER) AS my FROM (
    SELECT *, SQRT(dx*dx + dy*dy) AS len, CAST(LEAST(GREATEST(FLOOR(SQRT(5*GREATEST(ABS(dx), ABS(dy))) + 0.5E0), 5), 25) AS INTEGER) AS n FROM (
     SELECT a.session_id, a.frame_idx, pair_idx, a.cand_idx AS cand_a, b.cand_idx AS cand_b, a.score AS a_score, b.score AS b_score, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy
     FROM qcand_t a JOIN (VALUES {','.join(f'({i},{a},{b})' for i, (a, b) in enumerate(PAIRS))}) t(pair_idx, pa, pb) ON a.part = pa
      JOIN qcand_t b ON b.session_id = a.session_id AND b.frame_idx = a.frame_idx AND b.part = pb)), (SELECT UNNEST(RANGE(25)) AS k) WHERE k < n) q
   LEFT JOIN grid_t gx ON gx.session_id = q.session_id AND gx.frame_idx = q.frame_idx AND gx.cy = my AND gx.cx = mx AND gx.v > 0.1E0 LEFT JOIN grid_t gy ON gy.session_id = q.session_id AND gy.frame_idx = q.frame_idx AND gy.cy = mx AND gy.cx = my) p
 GROUP BY ALL)""",
)


def quadrant_candidates(spark, sf):
    from pyspark.sql import Window as W

    part = (F.floor(F.col("cy") / 4) * 2 + F.floor(F.col("cx") / 4)).cast("int")
    bright = fx.grid(spark, sf).where("v > 0.12").withColumn("part", part)
    w = W.partitionBy("session_id", "frame_idx", "part").orderBy("cy", "cx")
    return bright.select(
        "session_id", "frame_idx", "part", (F.row_number().over(w) - 1).alias("cand_idx"), F.col("cx").cast("double").alias("x"),
        F.col("cy").cast("double").alias("y"), F.col("v").alias("score"),
    )


def limbs(spark, sf):
    g = fx.grid(spark, sf)
    across = g.select("session_id", "frame_idx", F.col("cx").alias("cy"), F.col("cy").alias("cx"), F.col("v").alias("fy"))
    ids = F.array(*[F.lit(i) for i in range(len(PAIRS))])
    field = g.where("v > 0.1").join(across, ["session_id", "frame_idx", "cy", "cx"]).select(  # cells below are missing
        "session_id", "frame_idx", F.explode(ids).alias("pair_idx"), "cy", "cx", F.col("v").alias("fx"), "fy"
    )
    ends = G.candidate_pairs(quadrant_candidates(spark, sf), PAIRS)
    return G.limb_scores(ends, field, SIZE, SIZE, 0.05, 0.4, 0.05)


LIMB = "session_id, frame_idx, pair_idx, cand_a, cand_b"


@query("limb_scores", f"SELECT {LIMB}, ROUND(score, 6) + 0.0E0 AS score FROM limb_t")
def _(spark, sf):
    return rounded(limbs(spark, sf).drop("a_score", "b_score"), "score")


@query(
    "limb_match_greedy",
    """WITH RECURSIVE r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx, pair_idx ORDER BY score DESC, cand_a DESC, cand_b DESC) AS rn FROM limb_t WHERE score > 1E-6),
 walk AS (SELECT session_id, frame_idx, pair_idx, CAST(0 AS BIGINT) AS rn, CAST([] AS INTEGER[]) AS ua, CAST([] AS INTEGER[]) AS ub, FALSE AS taken, 0 AS cand_a, 0 AS cand_b, 0.0E0 AS score
   FROM (SELECT DISTINCT session_id, frame_idx, pair_idx FROM r)
  UNION ALL SELECT r.session_id, r.frame_idx, r.pair_idx, r.rn, CASE WHEN ok THEN list_append(ua, r.cand_a) ELSE ua END, CASE WHEN ok THEN list_append(ub, r.cand_b) ELSE ub END, ok, r.cand_a, r.cand_b, r.score
   FROM walk w JOIN r ON r.session_id = w.session_id AND r.frame_idx = w.frame_idx AND r.pair_idx = w.pair_idx AND r.rn = w.rn + 1,
    LATERAL (SELECT NOT list_contains(ua, r.cand_a) AND NOT list_contains(ub, r.cand_b) AS ok))
SELECT session_id, frame_idx, pair_idx, cand_a, cand_b, ROUND(score, 6) AS score FROM walk WHERE taken""",
)
def _(spark, sf):
    return rounded(G.limb_match_greedy(limbs(spark, sf)), "score")


@query("limb_rank_global", f"""SELECT {LIMB}, ROUND(total, 6) AS total, CAST(ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx ORDER BY total DESC, score DESC, pair_idx DESC, cand_a DESC, cand_b DESC) AS INTEGER) AS rank
FROM (SELECT *, score + 0.1E0*a_score + 0.1E0*b_score AS total FROM limb_t WHERE score > 1E-6)""")
def _(spark, sf):
    return rounded(G.limb_rank_global(limbs(spark, sf)).drop("score", "a_score", "b_score"), "total")


@query("assemble_people")
def _(spark, sf):
    return G.assemble_people(limbs(spark, sf), PAIRS)


# People as part rows: joints shifted up by six on odd events, so that feet occur.
cte(
    "partrows_t",
    """SELECT session_id, frame_idx, person_idx, part, SUM(c) OVER (PARTITION BY session_id, frame_idx, person_idx)*0.55E0 AS score FROM (
 SELECT k.*, joint + CASE WHEN f.event_id % 2 = 1 THEN 6 ELSE 0 END AS part FROM people_t k JOIN frames_t f ON f.session_id = k.session_id AND f.frame_idx = k.frame_idx
 WHERE c > 0 AND (f.event_id % 4 <> 1 OR joint BETWEEN 10 AND 12 + person_idx OR joint >= 13 + f.event_id % 3))""",
)


def part_rows(spark, sf):
    ppl = fx.people(spark, sf).where("c > 0")
    ev = fx.frames(spark, sf).select("session_id", "frame_idx", "event_id")
    e, j = F.col("event_id"), F.col("joint")
    kept = ppl.join(ev.hint("merge"), ["session_id", "frame_idx"]).where(  # a row a frame: not to be broadcast
        (e % 4 != 1) | j.between(10, F.col("person_idx") + 12) | (j >= e % 3 + 13)
    )
    rows = kept.select(*P.PERSON, (j + F.when(e % 2 == 1, 6).otherwise(0)).alias("part"), "c")
    total = rows.groupBy(*P.PERSON).agg((F.sum("c") * 0.55).alias("score"))
    return rows.drop("c").join(total, list(P.PERSON))


@query(
    "filter_people",
    """SELECT session_id, frame_idx, person_idx, n_all, n_feet, ROUND(score, 6) AS score FROM (
 SELECT *, BOOL_OR(strict) OVER (PARTITION BY session_id, frame_idx) AS alive FROM (
  SELECT *, NOT (n_feet > 0 AND n_all - n_feet <= 4) AND n_all - n_feet >= 3 AND score/(n_all - n_feet) >= 0.4E0 AS strict, n_all >= 3 AND score/n_all >= 0.4E0 AS lenient FROM (
   SELECT session_id, frame_idx, person_idx, COUNT(*) AS n_all, COUNT(*) FILTER (part BETWEEN 19 AND 24) AS n_feet, MAX(score) AS score FROM partrows_t GROUP BY ALL)))
WHERE strict OR (NOT alive AND lenient)""",
)
def _(spark, sf):
    return rounded(G.filter_people(part_rows(spark, sf), P.PERSON), "score")


@query(
    "people_to_keypoints",
    """WITH p AS (SELECT session_id, frame_idx, person_idx, SUM(c)/51 AS person_score FROM people_t WHERE c > 0 GROUP BY ALL)
SELECT p.session_id, p.frame_idx, p.person_idx, CAST(j AS INTEGER) AS part, ROUND(person_score, 6) AS person_score, ROUND(COALESCE(x*2, 0), 6) AS x,
  ROUND(COALESCE(y*2, 0), 6) + 0.0E0 AS y, ROUND(COALESCE(c, 0), 6) AS c
FROM p CROSS JOIN (SELECT UNNEST(RANGE(25)) AS j) LEFT JOIN people_t k ON k.session_id = p.session_id AND k.frame_idx = p.frame_idx AND k.person_idx = p.person_idx AND k.joint = j AND k.c > 0""",
)
def _(spark, sf):
    seen = fx.dealt_people(spark, sf).where("c > 0").withColumnRenamed("joint", "part")
    keys = ["session_id", "frame_idx", "_deal", "person_idx"]
    total = seen.groupBy(*keys).agg(F.sum("c").alias("score"))
    parts = seen.select(*keys, "part", F.col("person_idx").alias("cand_idx")).join(total, keys)
    spots = seen.select(*keys[:-1], "part", F.col("person_idx").alias("cand_idx"), "x", "y", "c")
    out = G.people_to_keypoints(parts, spots, keys, 25, len(model.PART_PAIRS["parts25"]), 2.0).drop("_deal")
    return rounded(out, "person_score", "x", "y", "c")


cte(
    "facebox_t",
    """SELECT l_orderkey % 2 AS session_id, l_orderkey // 2 AS frame_idx, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) - 1 AS INTEGER) AS person_idx,
  l_returnflag = 'R' AS stray, CAST(l_partkey % 60 AS DOUBLE) AS box_x, CAST(l_suppkey % 60 AS DOUBLE) AS box_y, 20.0E0 + l_quantity AS box_w, 25.0E0 + l_quantity AS box_h FROM lineitem""",
)


@query(
    "merge_stray_faces",
    """SELECT session_id, frame_idx, stray_person, person_idx, ROUND(iou, 6) AS iou FROM (
 SELECT a.session_id, a.frame_idx, a.person_idx AS stray_person, b.person_idx, iou, ROW_NUMBER() OVER (PARTITION BY a.session_id, a.frame_idx, a.person_idx ORDER BY iou DESC, b.person_idx) AS rn,
  (SELECT COUNT(*) FROM facebox_t f WHERE f.session_id = a.session_id AND f.frame_idx = a.frame_idx AND NOT f.stray) AS n_valid
 FROM facebox_t a JOIN facebox_t b ON a.session_id = b.session_id AND a.frame_idx = b.frame_idx AND a.stray AND NOT b.stray,
  LATERAL (SELECT LEAST(a.box_x + a.box_w, b.box_x + b.box_w) - GREATEST(a.box_x, b.box_x) AS iw, LEAST(a.box_y + a.box_h, b.box_y + b.box_h) - GREATEST(a.box_y, b.box_y) AS ih),
  LATERAL (SELECT iw*ih/(a.box_w*a.box_h + b.box_w*b.box_h - iw*ih) AS iou) WHERE iw > 0 AND ih > 0) WHERE rn = 1 AND (iou > 0.3E0 OR (iou > 0.01E0 AND n_valid < 3))""",
)
def _(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    faces = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 2).alias("session_id"), F.floor(F.col("l_orderkey") / 2).alias("frame_idx"), (F.row_number().over(w) - 1).alias("person_idx"), (F.col("l_returnflag") == "R").alias("stray"),
        (F.col("l_partkey") % 60).cast("double").alias("box_x"), (F.col("l_suppkey") % 60).cast("double").alias("box_y"),
        (20.0 + F.col("l_quantity")).alias("box_w"), (25.0 + F.col("l_quantity")).alias("box_h"),
    )
    return rounded(G.merge_stray_faces(faces), "iou")


@query("sort_candidates", "SELECT session_id, frame_idx, part, cand_idx, ROUND(score, 6) AS score, CAST(ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx, part ORDER BY score DESC, cand_idx) - 1 AS INTEGER) AS pos FROM cand_t")
def _(spark, sf):
    lists = G.candidate_lists(fx.candidates(spark, sf))
    out = lists.select("session_id", "frame_idx", "part", F.posexplode("candidates").alias("pos", "e")).select(
        "session_id", "frame_idx", "part", "e.cand_idx", "e.score", "pos"
    )
    return rounded(out, "score")


@query("candidate_lists", """SELECT session_id, frame_idx, part, COUNT(*) AS n, STRING_AGG(cand_idx || ':' || CAST(CAST(x AS INTEGER) AS VARCHAR) || ',' || CAST(CAST(y AS INTEGER) AS VARCHAR), ' ' ORDER BY score DESC, cand_idx) AS candidates
FROM cand_t GROUP BY ALL""")
def _(spark, sf):
    lists = G.candidate_lists(fx.candidates(spark, sf))
    text = F.transform(
        "candidates", lambda e: F.concat(e["cand_idx"].cast("string"), F.lit(":"), e["x"].cast("int").cast("string"), F.lit(","), e["y"].cast("int").cast("string"))
    )
    return lists.select("session_id", "frame_idx", "part", F.size("candidates").cast("bigint").alias("n"), F.array_join(text, " ").alias("candidates"))

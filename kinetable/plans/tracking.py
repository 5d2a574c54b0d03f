"""Identity and latch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracking as T
from . import fixtures as fx
from .registry import query, rounded

RADIUS = T.match_radius(fx.WIDTH, fx.HEIGHT)


@query("track_pair_scores", f"""SELECT session_id, frame_idx, person_a, person_b, active, inliers, ROUND(inliers/CAST(active AS DOUBLE), 6) AS score, ROUND(distance, 5) AS distance FROM (
 SELECT a.session_id, a.frame_idx, a.person_idx AS person_a, b.person_idx AS person_b, COUNT(*) AS active, COUNT(*) FILTER (d < {RADIUS!r}E0) AS inliers, SUM(d) AS distance
 FROM people_t a JOIN people_t b ON a.session_id = b.session_id AND a.frame_idx = b.frame_idx + 1 AND a.joint = b.joint AND a.c >= 0.1E0 AND b.c >= 0.1E0,
  LATERAL (SELECT SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2)) AS d) GROUP BY ALL) WHERE inliers >= 1 AND inliers/CAST(active AS DOUBLE) >= 0.5E0""")
def _(spark, sf):
    ppl, before = fx.dealt_people(spark, sf), fx.dealt_people(spark, sf, 1)
    out = T.track_pair_scores(ppl, before, RADIUS, frame=("session_id", "frame_idx", "_deal")).drop("_deal")
    return rounded(rounded(out, "score"), "distance", digits=5)


# Four known people a session stand 150 apart, come and go, and are listed in another order in every frame.
KNOWN = """SELECT session_id, frame_idx, event_id, k, CAST(ROW_NUMBER() OVER (PARTITION BY session_id, frame_idx ORDER BY (k + frame_idx) % 4) - 1 AS INTEGER) AS person_idx
 FROM frames_t JOIN (SELECT UNNEST([0, 1, 2, 3]) AS k) p ON (event_id // (k + 2) + k) % 9 < 4"""


def known_people(spark, sf):
    """Keypoints of the known people: three joints, jitter well below the radius."""
    at, k, e = F.col("frame_idx"), F.col("k"), F.col("event_id")
    order = F.array_sort(F.filter(F.array(*[F.lit(x) for x in range(4)]), lambda k: (F.floor(e / (k + 2)) + k) % 9 < 4), lambda a, b: ((a + at) % 4 - (b + at) % 4).cast("int"))
    some = fx.frames(spark, sf).select("session_id", "frame_idx", "event_id", F.posexplode(order).alias("person_idx", "k"))
    return some.select(
        "session_id", "frame_idx", "person_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("joint"),
        (150.0 * k + (e % 3)).alias("x"), (100.0 + (e % 5)).alias("y"), F.lit(0.9).alias("c"),
    )


@query("link_known_people", f"""SELECT session_id, frame_idx, person_idx, LAST_VALUE(opened IGNORE NULLS) OVER (PARTITION BY session_id, k ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS track_id
FROM (SELECT *, CASE WHEN fresh THEN SUM(CAST(fresh AS BIGINT)) OVER (PARTITION BY session_id ORDER BY frame_idx, person_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - 1 END AS opened
 FROM (SELECT *, COALESCE(frame_idx - LAG(frame_idx) OVER (PARTITION BY session_id, k ORDER BY frame_idx) > {T.EXPIRE + 1}, TRUE) AS fresh FROM ({KNOWN})))""")
def _(spark, sf):
    return T.link_track_ids(known_people(spark, sf), 3, RADIUS)


@query("link_track_ids")
def _(spark, sf):
    return T.link_track_ids(fx.people(spark, sf).where("c > 0"), 19, RADIUS)


def latch_sql(hold: int, clear: int) -> str:
    cleared = f"l1 AND st1 >= {clear}" if clear else "FALSE"
    expired = f"f.frame_idx - s1 >= {hold}" if hold else "FALSE"
    return f"""WITH RECURSIVE f AS (SELECT session_id, frame_idx, event_type = 'error' AND value > 20 AS c, event_type IN ('view', 'click') AS u FROM frames_t),
 w AS (SELECT session_id, CAST(-1 AS BIGINT) AS frame_idx, FALSE AS latched, CAST(0 AS BIGINT) AS since, 0 AS st FROM f WHERE frame_idx = 0
  UNION ALL SELECT f.session_id, f.frame_idx, l1 AND NOT cleared AND NOT expired, s1, CASE WHEN cleared OR (l1 AND expired) THEN 0 ELSE st1 END
  FROM w JOIN f ON f.session_id = w.session_id AND f.frame_idx = w.frame_idx + 1,
   LATERAL (SELECT w.latched OR f.c AS l1, CASE WHEN f.c THEN f.frame_idx ELSE w.since END AS s1),
   LATERAL (SELECT CASE WHEN NOT l1 THEN w.st WHEN f.u THEN w.st + 1 ELSE 0 END AS st1),
   LATERAL (SELECT {cleared} AS cleared, {expired} AS expired))
SELECT session_id, frame_idx, latched FROM w WHERE frame_idx >= 0"""


def latched(spark, sf, hold, clear):
    fr = fx.frames(spark, sf)
    confirm = (F.col("event_type") == "error") & (F.col("value") > 20)
    return T.latch_with_release(fr, confirm, F.col("event_type").isin("view", "click"), hold, clear)


@query("latch_with_release", latch_sql(8, 3))
def _(spark, sf):
    return latched(spark, sf, 8, 3)


@query("latch_until_upright", latch_sql(0, 4))
def _(spark, sf):
    return latched(spark, sf, 0, 4)


@query("latch_for_ever", latch_sql(0, 0))
def _(spark, sf):
    return latched(spark, sf, 0, 0)

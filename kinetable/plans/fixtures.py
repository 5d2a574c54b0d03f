"""Pose-shaped tables derived from the given tables, in Spark and as SQL building blocks.

Each user of ``events`` is a session, its events in time order are the frames, and every frame
shows a 19-joint figure.  Two sessions in three topple, at five speeds; joints and whole frames go
missing.  The SQL blocks give DuckDB the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.chunks import dense_index, time_bucket
from .registry import cte, table

FPS = 10.0
WIDTH, HEIGHT = 640, 480

# Offsets of the standing figure (joint, dx, dy).
FIGURE = (
    (0, 0.0, -180.0), (1, 0.0, -110.0), (2, -20.0, -110.0), (3, -30.0, -60.0), (4, -32.0, -10.0),
    (5, 20.0, -110.0), (6, 30.0, -60.0), (7, 32.0, -10.0), (8, 0.0, 0.0), (9, -20.0, 0.0),
    (10, -20.0, 80.0), (11, -20.0, 155.0), (12, 20.0, 0.0), (13, 20.0, 80.0), (14, 20.0, 155.0),
    (15, -6.0, -190.0), (16, 6.0, -190.0), (17, -14.0, -182.0), (18, 14.0, -182.0),
)
# The joints lie in blocks, so that frames meet them by an equi-join.
BLOCKS = 2
_body = ", ".join(f"({j % BLOCKS}, {j}, {dx}D, {dy}D)" for j, dx, dy in FIGURE)
# Frames a task: of those whose people are gathered, and of those whose people are joined, sorted in memory.
FRAMES_A_TASK, FRAMES_JOINED = 20_000, 5_000


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """(session_id, frame_idx, event_id, ts, event_type, value), dense positions per session."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts", "event_type", "value"
    )
    return dense_index(events, ["session_id"], ["ts", "event_id"], time_bucket("ts"), "frame_idx")


def keypoints(spark: SparkSession, sf: str) -> DataFrame:
    return _figure(frames(spark, sf)).drop("event_id")


def _tasks(spark: SparkSession, sf: str, frames_a_task: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "events").count() // frames_a_task))


def by_frame(spark: SparkSession, sf: str, frames_a_task: int = FRAMES_A_TASK) -> DataFrame:
    """The frames dealt out by frame, so many a task; the rows that are made of one stay together in it."""
    return frames(spark, sf).repartition(_tasks(spark, sf, frames_a_task), "session_id", "frame_idx")


def dealt(spark: SparkSession, sf: str, later: int = 0) -> DataFrame:
    """The same by a number of their own, ``_deal``; ``_at`` is the frame's position moved by ``later``, by which it is dealt.

    Tables made of such frames are joined without exchange on any keys that have ``_deal`` among them.
    """
    tasks = _tasks(spark, sf, FRAMES_JOINED)
    moved = frames(spark, sf).withColumn("_at", F.col("frame_idx") + later)
    return moved.withColumn("_deal", F.pmod(F.xxhash64("session_id", "_at"), F.lit(tasks)).cast("int")).repartitionById(tasks, "_deal")


def _figure(frame_rows: DataFrame, *keep: str) -> DataFrame:
    """The joints come by a join, not from an array: the engine multiplies the sizes then, and takes no derived table for one small enough to broadcast."""
    body = frame_rows.sparkSession.sql(f"SELECT * FROM VALUES {_body} AS t(_block, joint, dx, dy)")
    blocks = F.explode(F.array(*[F.lit(b) for b in range(BLOCKS)]))
    s, i, e, j = (F.col(n) for n in ("session_id", "frame_idx", "event_id", "joint"))
    topple = F.when(s % 3 == 0, F.lit(0.0)).otherwise(
        F.least(
            F.greatest((i - (F.lit(24) + s % 7)) / (F.lit(4.0) + F.lit(6.0) * (s % 5)), F.lit(0.0)), F.lit(1.0)
        )
    )
    p = F.col("p")
    miss = (e % 23 == 0) | ((e + j * 5) % 17 == 0)
    x = F.lit(320.0) + F.col("dx") * (1.0 - p) + p * (F.lit(6.0) * j) + (e % 3).cast("double")
    y = F.lit(260.0) + F.lit(130.0) * p + F.col("dy") * (1.0 - p) - F.lit(4.0) * p * (j % 5)
    return (
        frame_rows.select("session_id", "frame_idx", "event_id", *keep, topple.alias("p"), blocks.alias("_block")).join(F.broadcast(body), "_block")
        .select(
            "session_id",
            "frame_idx",
            "event_id",
            "joint",
            F.when(~miss, x).alias("x"),
            F.when(~miss, y).alias("y"),
            F.when(miss, F.lit(0.0)).otherwise(F.lit(0.5) + F.lit(0.01) * ((e * 7 + j * 3) % 50)).alias("c"),
            *keep,
        )
    )


def _people(kp: DataFrame, *frame: Column | str) -> DataFrame:
    n = (F.col("event_id") % 4).cast("int")
    return kp.withColumn("person_idx", F.explode(F.sequence(F.lit(0), n))).select(
        *frame,
        "person_idx",
        "joint",
        (F.col("x") + 60.0 * F.col("person_idx")).alias("x"),
        "y",
        (F.col("c") * (1.0 - 0.1 * F.col("person_idx"))).alias("c"),
    )


def people(spark: SparkSession, sf: str) -> DataFrame:
    """1 to 4 people per frame: shifted copies with falling confidence."""
    return _people(_figure(by_frame(spark, sf)), "session_id", "frame_idx")


def dealt_people(spark: SparkSession, sf: str, later: int = 0) -> DataFrame:
    """The people with ``_deal``, under the position of the frame that comes ``later``."""
    return _people(_figure(dealt(spark, sf, later), "_at", "_deal"), "session_id", F.col("_at").alias("frame_idx"), "_deal")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("session_id")
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("session_id"))
        .agg(F.count("*").alias("n_frames"))
        .select(
            "session_id",
            F.lit(FPS).alias("fps"),
            F.lit(WIDTH).alias("frame_width"),
            F.lit(HEIGHT).alias("frame_height"),
            F.when((s % 3 == 0) | (s % 5 > 1), "normal").otherwise("fall").alias("label"),
            F.element_at(F.array(F.lit("bed"), F.lit("chair"), F.lit("stand")), (s % 3).cast("int") + 1).alias("category"),
            (s % 4 + 1).alias("subject"),
            "n_frames",
        )
    )


def clip_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Classifier probabilities per labelled document, split by id."""
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("clip_id"),
        F.when(d % 5 == 0, "test").when(d % 5 == 1, "validation").otherwise("train").alias("split"),
        F.col("quality").alias("truth"),
        ((d * 37) % 1000 / 1000.0).alias("p_legacy"),
        ((d * 53) % 1000 / 1000.0).alias("p_pose"),
        ((d * 71) % 1000 / 1000.0).alias("p_engineered"),
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """8x8 raster per embedding: (session_id, frame_idx, part, cy, cx, v); two sessions share the frame numbers."""
    return (
        table(spark, sf, "embeddings")
        .select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
        .select(
            (F.col("vec_id") % 2).alias("session_id"),
            F.floor(F.col("vec_id") / 2).alias("frame_idx"),
            F.col("label").alias("part"),
            F.floor(F.col("pos") / 8).cast("int").alias("cy"),
            (F.col("pos") % 8).alias("cx"),
            F.col("v").cast("double").alias("v"),
        )
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Part candidates: one frame per order, part = line number modulo 4, ragged lists; two sessions share the frame numbers."""
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 2).alias("session_id"), F.floor(F.col("l_orderkey") / 2).alias("frame_idx"),
        ((F.col("l_linenumber") - 1) % 4).alias("part"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice",
    )
    from pyspark.sql import Window as W

    w = W.partitionBy("session_id", "frame_idx", "part").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"
    )
    return li.select(
        "session_id",
        "frame_idx",
        "part",
        (F.row_number().over(w) - 1).alias("cand_idx"),
        (F.col("l_partkey") % 64).cast("double").alias("x"),
        (F.col("l_suppkey") % 48).cast("double").alias("y"),
        (F.col("l_discount") + F.col("l_quantity") / 100).alias("score"),
    )


_values = ",".join(f"({j},{dx}E0,{dy}E0)" for j, dx, dy in FIGURE)

cte(
    "frames_t",
    """SELECT CAST(user_id AS BIGINT) AS session_id, event_id, ts, event_type, value,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx FROM events""",
)
cte(
    "figure_t",
    f"""SELECT session_id, frame_idx, event_id, joint,
  CASE WHEN miss THEN NULL ELSE x END AS x, CASE WHEN miss THEN NULL ELSE y END AS y,
  CASE WHEN miss THEN 0.0E0 ELSE 0.5E0 + 0.01E0*((event_id*7 + joint*3) % 50) END AS c
FROM (
 SELECT session_id, frame_idx, event_id, joint,
  (event_id % 23 = 0) OR ((event_id + joint*5) % 17 = 0) AS miss,
  320.0E0 + dx*(1.0E0-p) + p*(6.0E0*joint) + CAST(event_id % 3 AS DOUBLE) AS x,
  260.0E0 + 130.0E0*p + dy*(1.0E0-p) - 4.0E0*p*(joint % 5) AS y
 FROM (
  SELECT f.session_id, f.frame_idx, f.event_id, j.joint, j.dx, j.dy,
   CASE WHEN f.session_id % 3 = 0 THEN 0.0E0
        ELSE LEAST(GREATEST((f.frame_idx - (24 + f.session_id % 7)) / (4.0E0 + 6.0E0*(f.session_id % 5)), 0.0E0), 1.0E0) END AS p
  FROM frames_t f CROSS JOIN (SELECT * FROM (VALUES {_values}) AS t(joint,dx,dy)) j
 ) q
) z""",
)
cte("kp_t", "SELECT session_id, frame_idx, joint, x, y, c FROM figure_t")
cte(
    "people_t",
    """SELECT session_id, frame_idx, CAST(p.k AS INTEGER) AS person_idx, joint, x + 60.0E0*p.k AS x, y,
  c * (1.0E0 - 0.1E0*p.k) AS c FROM figure_t JOIN (SELECT UNNEST([0,1,2,3]) AS k) p ON p.k <= event_id % 4""",
)
cte(
    "sessions_t",
    f"""SELECT CAST(user_id AS BIGINT) AS session_id, {FPS}E0 AS fps, {WIDTH} AS frame_width, {HEIGHT} AS frame_height,
  CASE WHEN user_id % 3 = 0 OR user_id % 5 > 1 THEN 'normal' ELSE 'fall' END AS label,
  CASE user_id % 3 WHEN 0 THEN 'bed' WHEN 1 THEN 'chair' ELSE 'stand' END AS category,
  user_id % 4 + 1 AS subject, COUNT(*) AS n_frames FROM events GROUP BY user_id""",
)
cte(
    "scores_t",
    """SELECT d.doc_id AS clip_id,
  CASE WHEN d.doc_id % 5 = 0 THEN 'test' WHEN d.doc_id % 5 = 1 THEN 'validation' ELSE 'train' END AS split,
  l.quality AS truth, (d.doc_id*37) % 1000 / 1000.0E0 AS p_legacy, (d.doc_id*53) % 1000 / 1000.0E0 AS p_pose,
  (d.doc_id*71) % 1000 / 1000.0E0 AS p_engineered FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
cte(
    "grid_t",
    """SELECT vec_id % 2 AS session_id, vec_id // 2 AS frame_idx, label AS part, CAST(k // 8 AS INTEGER) AS cy, CAST(k % 8 AS INTEGER) AS cx,
  CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, (SELECT UNNEST(RANGE(64)) AS k) r""",
)
cte(
    "cand_t",
    """SELECT l_orderkey % 2 AS session_id, l_orderkey // 2 AS frame_idx, (l_linenumber - 1) % 4 AS part,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) % 4
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) - 1 AS INTEGER) AS cand_idx,
  CAST(l_partkey % 64 AS DOUBLE) AS x, CAST(l_suppkey % 48 AS DOUBLE) AS y,
  l_discount + l_quantity / 100 AS score FROM lineitem""",
)

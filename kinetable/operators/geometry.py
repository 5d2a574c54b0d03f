"""Per-frame body geometry from long keypoints (one row per session, frame and joint)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Joint numbers of the 25-part skeleton.
NOSE, NECK = 0, 1
R_SHOULDER, L_SHOULDER = 2, 5
MID_HIP, R_HIP, L_HIP = 8, 9, 12
BODY_JOINTS = list(range(15))

HEAD = ((NOSE, NECK), (R_SHOULDER, L_SHOULDER))
HIP = ((MID_HIP,), (R_HIP, L_HIP))
SHOULDER = ((R_SHOULDER, L_SHOULDER), (NECK,))


def valid_joint(threshold: float) -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("c") >= threshold)


def frame_geometry(keypoints: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Head, hip and shoulder points, torso angle, box aspect and body height of every frame.

    One hash aggregation on (session, frame): partial sums are built before the exchange, so the
    rows that travel are frames, not joints.  Confidence-weighted coordinates are prepared per row
    first; the aggregates then stay plain sums over joint groups, small enough to be compiled.
    """
    ok = valid_joint(threshold)
    body = F.col("joint").isin(*BODY_JOINTS)
    rows = keypoints.select(
        "session_id", "frame_idx", "joint", F.coalesce(F.col("c") >= threshold, F.lit(False)).alias("_seen"),
        F.when(ok, F.col("c")).alias("_w"), F.when(ok, F.col("x") * F.col("c")).alias("_xw"), F.when(ok, F.col("y") * F.col("c")).alias("_yw"),
        F.when(ok & body, F.col("x")).alias("_bx"), F.when(ok & body, F.col("y")).alias("_by"),
        F.when(body & F.col("y").isNotNull() & (F.col("c") >= threshold), F.col("y")).alias("_ty"),
    )

    def mean(weighted, joints):
        pick = F.col("joint").isin(*joints)
        return F.try_divide(F.sum(F.when(pick, F.col(weighted))), F.sum(F.when(pick, F.col("_w"))))

    def point(weighted, spec):
        return F.coalesce(*[mean(weighted, joints) for joints in spec])

    g = rows.groupBy("session_id", "frame_idx").agg(
        F.max("_seen").alias("detected"),
        point("_xw", HEAD).alias("head_x"),
        point("_yw", HEAD).alias("head_y"),
        point("_xw", HIP).alias("hip_x"),
        point("_yw", HIP).alias("hip_y"),
        point("_xw", SHOULDER).alias("shoulder_x"),
        point("_yw", SHOULDER).alias("shoulder_y"),
        F.count("_bx").alias("_n"),
        (F.max("_bx") - F.min("_bx")).alias("_w"),
        (F.max("_by") - F.min("_by")).alias("_h"),
        F.count("_ty").alias("_nt"),
        (F.max("_ty") - F.min("_ty")).alias("_ht"),
    )
    dx = F.abs(F.col("shoulder_x") - F.col("hip_x"))
    dy = F.abs(F.col("shoulder_y") - F.col("hip_y"))
    return (
        g.withColumn("torso_angle", F.degrees(F.atan2(dx, dy)))
        .withColumn("bbox_aspect", F.when((F.col("_n") >= 5) & (F.col("_h") > 1), F.col("_w") / F.col("_h")))
        .withColumn("body_height", F.when((F.col("_nt") >= 5) & (F.col("_ht") > 1), F.col("_ht")))
        .drop("_n", "_w", "_h", "_nt", "_ht")
    )

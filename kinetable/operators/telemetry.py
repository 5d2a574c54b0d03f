"""Robot log formulas as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .chunks import by_chunk, core, halo, running_last


def projected_gravity(df: DataFrame, w: str, x: str, y: str, z: str) -> DataFrame:
    """Gravity direction (0, 0, -1) in the body frame: inverse quaternion rotation."""
    q = [F.col(x), F.col(y), F.col(z)]
    v = [F.lit(0.0), F.lit(0.0), F.lit(-1.0)]
    qw = F.col(w)
    cross = [q[1] * v[2] - q[2] * v[1], q[2] * v[0] - q[0] * v[2], q[0] * v[1] - q[1] * v[0]]
    dot = q[0] * v[0] + q[1] * v[1] + q[2] * v[2]
    return df.withColumns(
        {
            f"gravity_{n}": v[i] * (2.0 * qw * qw - 1.0) - 2.0 * qw * cross[i] + 2.0 * q[i] * dot
            for i, n in enumerate("xyz")
        }
    )


def unpack_observation(df: DataFrame, obs: str, joints: int, keep: Sequence[str]) -> DataFrame:
    """Observation vector to named columns, one row per joint."""
    o = F.col(obs)
    names = ["quat_w", "quat_x", "quat_y", "quat_z", "ang_x", "ang_y", "ang_z"]
    base = [o[i].alias(n) for i, n in enumerate(names)]
    tail = [o[7 + 2 * joints + i].alias(n) for i, n in enumerate(["mode", "command_x", "command_y", "command_yaw"])]
    pairs = F.arrays_zip(
        F.slice(o, 8, joints).alias("position"), F.slice(o, 8 + joints, joints).alias("velocity")
    )
    return (
        df.select(*keep, *base, *tail, F.posexplode(pairs).alias("joint_idx", "_j"))
        .withColumns({"position": F.col("_j.position"), "velocity": F.col("_j.velocity")})
        .drop("_j")
    )


def pd_torque(joints: DataFrame, config: DataFrame) -> DataFrame:
    """PD torque, clipped; joints without a target aim at 0.  ``config`` has one row per joint."""
    raw = F.col("kp") * (F.coalesce(F.col("target"), F.lit(0.0)) - F.col("position")) - F.col("kd") * F.col("velocity")
    lim = F.col("effort_limit")
    return (
        joints.join(config, "joint_idx")
        .withColumn("torque_raw", raw)
        .withColumn("torque", F.least(F.greatest(F.col("torque_raw"), -lim), lim))
        .withColumn("saturated", F.abs("torque_raw") > lim)
    )


def torque_saturation(torques: DataFrame, by: Sequence[str]) -> DataFrame:
    return torques.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.avg(F.col("saturated").cast("double")).alias("saturation"),
        F.avg("torque").alias("mean_torque"),
        F.max(F.abs("torque")).alias("peak_torque"),
    )


def clutch_delta(df: DataFrame, pressed: Column, value: str) -> DataFrame:
    """While the button is down, the value relative to where it was when the button went down."""
    marked = df.withColumn("pressed", pressed)
    wide = halo(marked, "frame_idx", 1, 0)
    was = F.lag("pressed").over(by_chunk(["session_id"], "frame_idx"))
    edged = core(wide.withColumn("edge", F.col("pressed") & F.coalesce(~was, F.lit(False)))).drop("_chunk")
    held = running_last(edged, ["session_id"], "frame_idx", {"anchor": F.when(F.col("edge"), F.col(value))})
    return held.withColumn("delta", F.when(F.col("pressed"), F.col(value) - F.col("anchor")))

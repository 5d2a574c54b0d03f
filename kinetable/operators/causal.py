"""Fall states as a live detector sees them, computed over stored frames with windows.

Differs from ``detect`` on purpose: values are held over short gaps, smoothed over past frames
only, the baseline is frozen once the opening seconds have shown a body, and an absent person is
reported after half a second.  A fall stays latched.  This is the batch twin of
``streaming.detector`` with its default release settings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import frames
from ..scratch import written
from .chunks import by_chunk, core, halo, join_per_key, last_positions, spread_to_chunks
from .detect import (
    FALL_CANDIDATE, FALLEN, FALLING, NORMAL, UNKNOWN, RuleConfig, evidence_inputs, fall_score, first_fallen,
    recent_motion, threshold_columns,
)
from .timeseries import SERIES


def _held(value: str, w: W, gap: int) -> Column:
    return F.coalesce(F.col(value), *[F.lag(value, k).over(w) for k in range(1, gap + 1)])


def _past_median(value: str, w: W, radius: int) -> Column:
    near = [F.col(value)] + [F.lag(value, k).over(w) for k in range(1, radius + 1)]
    ordered = F.sort_array(F.array(*near))
    n = sum((v.isNotNull().cast("int") for v in near[1:]), near[0].isNotNull().cast("int"))
    first = F.lit(radius + 2) - n
    low = F.element_at(ordered, first + F.floor((n - 1) / 2).cast("int"))
    high = F.element_at(ordered, first + F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def causal_series(df: DataFrame, fps: float) -> DataFrame:
    """Held and smoothed series on a frame table that carries its halo."""
    w = by_chunk(["session_id"], "frame_idx")
    gap, radius = frames(fps, 0.3), frames(fps, 0.15)
    held = df.withColumns({v: _held(v, w, gap) for v in SERIES})
    return held.withColumns({v: _past_median(v, w, radius) for v in SERIES})


def frozen_baseline(geometry: DataFrame, fps: float, frame_height: int, seconds: float = 2.0) -> DataFrame:
    """Calibration end and the baselines fixed there.

    The calibration closes at the end of its seconds, or at the first body after them.
    """
    gap, radius = frames(fps, 0.3), frames(fps, 0.15)
    closes = geometry.groupBy("session_id").agg(
        F.greatest(F.lit(frames(fps, seconds) - 1), F.min(F.when(F.col("body_height").isNotNull(), F.col("frame_idx")))).alias("calibrated_at"),
        F.count("body_height").alias("_seen"),
    ).where("_seen > 0").drop("_seen").withColumn("_last", F.col("calibrated_at"))  # no later chunk matters
    slim = geometry.select("session_id", "frame_idx", "body_height", *SERIES)
    opening = core(causal_series(halo(slim, "frame_idx", gap + radius, 0), fps)).drop("_chunk")
    return (
        join_per_key(opening, closes, ["session_id"], "frame_idx")
        .where(F.col("frame_idx") <= F.col("calibrated_at"))
        .groupBy("session_id", "calibrated_at")
        .agg(F.percentile("body_height", 0.5).alias("_h"), F.percentile("hip_y", 0.5).alias("_hip"))
        .select(
            "session_id", "calibrated_at",
            F.greatest("_h", F.lit(frame_height * 0.15)).alias("baseline_body_height"),
            F.coalesce("_hip", F.lit(frame_height * 0.5)).alias("baseline_hip_y"),
        )
    )


def causal_fall_states(
    geometry: DataFrame, fps: float, frame_height: int, config: RuleConfig | None = None
) -> DataFrame:
    """State, latch and evidence of every frame, one exchange of the frames."""
    config = config or RuleConfig()
    geometry = written(geometry, "geometry")
    gap, radius = frames(fps, 0.3), frames(fps, 0.15)
    speed, drop = frames(fps, 0.4), frames(fps, 1.0)
    window = frames(fps, config.evidence_window_seconds)
    lost = frames(fps, config.missing_confirmation_seconds)
    absent = frames(fps, 0.5)
    before = gap + radius + max(speed, drop) + window + lost + absent + window
    slim = geometry.select("session_id", "frame_idx", "detected", *SERIES)
    w = by_chunk(["session_id"], "frame_idx")
    series = causal_series(halo(slim, "frame_idx", before, 0), fps).withColumns(
        {f"_{p}_{n}": F.col(f"{p}_y") - F.lag(f"{p}_y", k).over(w)
         for p in ("hip", "head") for n, k in (("drop", drop), ("speed", speed))}
    )
    base = last_positions(geometry, ["session_id"], "frame_idx").join(
        frozen_baseline(geometry, fps, frame_height), "session_id", "left"
    )
    joined = series.join(spread_to_chunks(base, "_last"), ["session_id", "_chunk"])
    h = F.col("baseline_body_height")
    live = F.coalesce(F.col("frame_idx") > F.col("calibrated_at"), F.lit(False))
    rate = {"drop": F.lit(1.0), "speed": F.lit(float(fps)) / F.lit(speed)}
    measured = joined.withColumn("_live", live).withColumns(
        {f"{p}_{n}": F.when(live, F.col(f"_{p}_{n}") / h * rate[n]) for p in ("hip", "head") for n in ("drop", "speed")}
    )
    scored = fall_score(evidence_inputs(measured), threshold_columns(config))
    scored = scored.withColumns(
        {
            "low_hip": F.when(F.col("_live"), F.col("low_hip")).otherwise(F.lit(0.0)),
            "motion": F.col("_live") & F.col("motion"),
        }
    )
    scored = scored.withColumn("recent", recent_motion(w, window))
    scored = scored.withColumn("_lying", F.col("recent") & F.col("detected") & F.col("horizontal") & F.col("low"))
    unseen = F.sum((F.col("_live") & ~F.col("detected")).cast("int")).over(w.rowsBetween(-(absent - 1), 0))
    scored = scored.withColumn("_gone", unseen == absent)
    mark = (
        F.when(F.col("frame_idx") == F.col("calibrated_at"), NORMAL)
        .when(F.col("_lying"), FALL_CANDIDATE)
        .when(F.col("motion"), FALLING)
        .when(F.col("_live") & ~F.col("recent") & F.col("detected"), NORMAL)
        .when(F.col("_live") & ~F.col("recent") & F.col("_gone"), UNKNOWN)
    )
    missing = F.col("recent") & ~F.col("detected")
    found = core(
        scored.withColumn("_mark", mark).withColumns(
            {
                "open_state": F.coalesce(F.last("_mark", True).over(w.rowsBetween(-(window + absent), 0)), F.lit(UNKNOWN)),
                "lost": F.sum(missing.cast("int")).over(w.rowsBetween(-(lost - 1), 0)) == lost,
            }
        )
    )
    falls = spread_to_chunks(first_fallen(found, fps, config), "_last")
    calibrated = F.coalesce(F.col("frame_idx") >= F.col("calibrated_at"), F.lit(False))
    down = F.coalesce(F.col("frame_idx") >= F.col("first_fallen_frame"), F.lit(False))
    zero = F.lit(0.0)
    # before and at the end of calibration only posture counts
    posture = (
        F.least(F.col("angle") / config.min_torso_angle, F.lit(2.0)) * 0.15
        + F.least(F.col("aspect") / config.min_bbox_aspect, F.lit(2.0)) * 0.10
    )
    return found.join(falls, ["session_id", "_chunk"]).select(
        "session_id",
        "frame_idx",
        F.when(down, FALLEN).otherwise(F.col("open_state")).alias("state"),
        down.alias("fall_latched"),
        (~calibrated).alias("calibrating"),
        "detected",
        F.when(F.col("_live"), F.col("score")).when(calibrated, posture).otherwise(zero).alias("score"),
        F.when(F.col("_live"), F.col("speed")).otherwise(zero).alias("downward_speed"),
        F.when(F.col("_live"), F.col("drop")).otherwise(zero).alias("drop"),
        F.col("angle").alias("torso_angle"),
        F.col("aspect").alias("bbox_aspect"),
        "low_hip",
    )

"""Gap filling, smoothing and change series over frames (dense ``frame_idx`` per session)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import frames
from ..scratch import written
from .chunks import by_chunk, core, halo, last_positions, spread_to_chunks
from .geometry import frame_geometry

SERIES = ("head_y", "hip_y", "torso_angle", "bbox_aspect")


def gap_filled(value: str, w: W, max_gap: int) -> Column:
    """Linear interpolation of runs of at most ``max_gap`` NULLs bounded on both sides.

    Positions are dense, so the nearest known neighbours are offsets: cheaper than sliding frames.
    """
    back = [F.lag(value, k).over(w) for k in range(1, max_gap + 1)]
    ahead = [F.lead(value, k).over(w) for k in range(1, max_gap + 1)]
    l_dist = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in enumerate(back, 1)])
    r_dist = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in enumerate(ahead, 1)])
    left, right = F.coalesce(*back), F.coalesce(*ahead)
    span = l_dist + r_dist
    return F.coalesce(
        F.col(value), F.when(span - 1 <= max_gap, left + (right - left) * l_dist / span)
    )


def centred_median(value: str, w: W, radius: int) -> Column:
    """Median of the non-NULL values within ``radius`` rows."""
    near = [F.lag(value, k).over(w) for k in range(radius, 0, -1)]
    near += [F.col(value)] + [F.lead(value, k).over(w) for k in range(1, radius + 1)]
    # NULLs sort first, so the known values are the tail of the array
    ordered = F.sort_array(F.array(*near))
    n = sum((v.isNotNull().cast("int") for v in near[1:]), near[0].isNotNull().cast("int"))
    first = F.lit(2 * radius + 2) - n
    low = F.element_at(ordered, first + F.floor((n - 1) / 2).cast("int"))
    high = F.element_at(ordered, first + F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def fill_short_gaps(
    df: DataFrame, values: Sequence[str], max_gap: int, keys: Sequence[str] = ("session_id",), idx: str = "frame_idx"
) -> DataFrame:
    wide = halo(df, idx, max_gap, max_gap)
    w = by_chunk(keys, idx)
    return core(wide.withColumns({v: gap_filled(v, w, max_gap) for v in values})).drop("_chunk")


def rolling_median(
    df: DataFrame, values: Sequence[str], radius: int, keys: Sequence[str] = ("session_id",), idx: str = "frame_idx"
) -> DataFrame:
    wide = halo(df, idx, radius, radius)
    w = by_chunk(keys, idx)
    return core(wide.withColumns({v: centred_median(v, w, radius) for v in values})).drop("_chunk")


def trailing_change(
    df: DataFrame, changes: dict[str, tuple[str, int]], keys: Sequence[str] = ("session_id",), idx: str = "frame_idx"
) -> DataFrame:
    """``{new: (value, k)}`` adds ``value_t - value_{t-k}``."""
    wide = halo(df, idx, max(k for _, k in changes.values()), 0)
    w = by_chunk(keys, idx)
    return core(
        wide.withColumns({n: F.col(v) - F.lag(v, k).over(w) for n, (v, k) in changes.items()})
    ).drop("_chunk")


def smoothed(df: DataFrame, fps: float, values: Sequence[str] = SERIES) -> DataFrame:
    """Gap fill then median on a frame table that already carries its halo."""
    w = by_chunk(("session_id",), "frame_idx")
    gap, radius = frames(fps, 0.3), frames(fps, 0.15)
    filled = df.withColumns({v: gap_filled(v, w, gap) for v in values})
    return filled.withColumns({v: centred_median(v, w, radius) for v in values})


def reach(fps: float) -> int:
    """How far a smoothed value looks, in frames."""
    return frames(fps, 0.3) + frames(fps, 0.15)


def session_baseline(geometry: DataFrame, fps: float, frame_height: int) -> DataFrame:
    """Body height and hip level over the first two seconds of each session.

    Only the opening frames are kept before any window, so a group is a few dozen rows however
    long its session is.
    """
    count = frames(fps, 2.0)
    opening = geometry.where(F.col("frame_idx") < count + reach(fps)).select(
        "session_id", "frame_idx", "hip_y", "body_height", F.lit(0).cast("bigint").alias("_chunk")
    )
    early = F.col("frame_idx") < count
    return (
        smoothed(opening, fps, ["hip_y"])
        .groupBy("session_id")
        .agg(
            F.percentile(F.when(early, F.col("body_height")), 0.5).alias("_h"),
            F.percentile(F.when(early, F.col("hip_y")), 0.5).alias("_hip"),
        )
        .select(
            "session_id",
            F.greatest(F.coalesce("_h", F.lit(frame_height * 0.5)), F.lit(frame_height * 0.15)).alias(
                "baseline_body_height"
            ),
            F.coalesce("_hip", F.lit(frame_height * 0.5)).alias("baseline_hip_y"),
        )
    )


def features_with_halo(
    geometry: DataFrame, fps: float, frame_height: int, extra_before: int = 0
) -> DataFrame:
    """All feature series, still on (session, chunk) and with the halo rows kept.

    ``extra_before`` leaves correct values on that many rows before each chunk, for windows that
    follow.  Everything runs on one exchange: the baselines come in on the same partitioning.
    """
    speed, drop = frames(fps, 0.4), frames(fps, 1.0)
    w = by_chunk(("session_id",), "frame_idx")
    slim = geometry.select("session_id", "frame_idx", "detected", *SERIES)
    wide = halo(slim, "frame_idx", reach(fps) + max(speed, drop) + extra_before, reach(fps))
    series = smoothed(wide, fps).withColumns(
        {
            "_hip_d": F.col("hip_y") - F.lag("hip_y", drop).over(w),
            "_head_d": F.col("head_y") - F.lag("head_y", drop).over(w),
            "_hip_s": F.col("hip_y") - F.lag("hip_y", speed).over(w),
            "_head_s": F.col("head_y") - F.lag("head_y", speed).over(w),
        }
    )
    base = session_baseline(geometry, fps, frame_height).join(
        last_positions(geometry, ["session_id"], "frame_idx"), "session_id"
    )
    h = F.col("baseline_body_height")
    # The last chunk may look one chunk past the end: halo rows there are dropped by the join.
    return (
        series.join(spread_to_chunks(base, "_last"), ["session_id", "_chunk"])
        .withColumns(
            {
                "hip_drop": F.col("_hip_d") / h,
                "head_drop": F.col("_head_d") / h,
                "hip_speed": F.col("_hip_s") / h * F.lit(float(fps)) / F.lit(speed),
                "head_speed": F.col("_head_s") / h * F.lit(float(fps)) / F.lit(speed),
            }
        )
        .drop("_hip_d", "_head_d", "_hip_s", "_head_s")
    )


def extract_features(
    keypoints: DataFrame, fps: float, frame_height: int, threshold: float = 0.2
) -> DataFrame:
    """Keypoints to one row per frame with every feature series and the session baselines."""
    if fps <= 0:
        raise ValueError(f"fps must be positive, got {fps}")
    return core(features_with_halo(written(frame_geometry(keypoints, threshold), "geometry"), fps, frame_height)).drop("_chunk")

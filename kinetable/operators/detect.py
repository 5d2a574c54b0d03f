"""Rule-based fall states for whole recordings, as windows only.

FALLEN is absorbing, so the single sequential quantity is the first fallen frame.  It is the first
passage of a walk reflected at zero, which is a prefix scan over chunks (see ``chunks``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import finite_max, frames
from ..scratch import written
from .chunks import core, spread_to_chunks, walk_first_passage, walk_in_chunk
from .geometry import frame_geometry
from .timeseries import features_with_halo

NORMAL, FALLING, FALL_CANDIDATE, FALLEN, UNKNOWN = "NORMAL", "FALLING", "FALL_CANDIDATE", "FALLEN", "UNKNOWN"


@dataclass(frozen=True)
class RuleConfig:
    """Default thresholds of the rule."""

    min_downward_speed: float = 0.55
    min_drop: float = 0.30
    min_torso_angle: float = 48.0
    min_bbox_aspect: float = 0.85
    min_low_hip: float = 0.28
    evidence_window_seconds: float = 1.5
    confirmation_seconds: float = 0.5
    missing_confirmation_seconds: float = 0.5


THRESHOLDS = ("min_downward_speed", "min_drop", "min_torso_angle", "min_bbox_aspect", "min_low_hip")


def threshold_columns(config: RuleConfig) -> dict[str, Column]:
    return {t: F.lit(getattr(config, t)) for t in THRESHOLDS}


def evidence_inputs(features: DataFrame) -> DataFrame:
    """The five measurements of the rule with their zero defaults."""
    return features.withColumns(
        {
            "speed": finite_max(F.col("hip_speed"), F.col("head_speed")),
            "drop": finite_max(F.col("hip_drop"), F.col("head_drop")),
            "angle": F.coalesce("torso_angle", F.lit(0.0)),
            "aspect": F.coalesce("bbox_aspect", F.lit(0.0)),
            "low_hip": F.coalesce(
                (F.col("hip_y") - F.col("baseline_hip_y")) / F.col("baseline_body_height"), F.lit(0.0)
            ),
        }
    )


def fall_score(inputs: DataFrame, thresholds: dict[str, Column]) -> DataFrame:
    """Weighted score and the motion / horizontal / low predicates of every frame."""
    t = thresholds

    def part(value: Column, limit: Column, weight: float) -> Column:
        return F.least(value / limit, F.lit(2.0)) * F.lit(weight)

    score = (
        part(F.col("speed"), t["min_downward_speed"], 0.35)
        + part(F.col("drop"), t["min_drop"], 0.25)
        + part(F.col("angle"), t["min_torso_angle"], 0.15)
        + part(F.col("aspect"), t["min_bbox_aspect"], 0.10)
        + part(F.greatest(F.col("low_hip"), F.lit(0.0)), t["min_low_hip"], 0.15)
    )
    return inputs.withColumns(
        {
            "score": score,
            "motion": (F.col("speed") >= t["min_downward_speed"]) & (F.col("drop") >= t["min_drop"]),
            "horizontal": (F.col("angle") >= t["min_torso_angle"]) | (F.col("aspect") >= t["min_bbox_aspect"]),
            "low": F.col("low_hip") >= t["min_low_hip"],
        }
    )


def recent_motion(w: W, window: int) -> Column:
    return F.coalesce(F.max(F.col("motion").cast("int")).over(w.rowsBetween(-window, 0)) == 1, F.lit(False))


def evidence(scored: DataFrame, fps: float, config: RuleConfig, by: Sequence[str] = ()) -> DataFrame:
    """``recent``, the state a frame has before any confirmed fall, and the loss confirmation.

    Input and output stay on (session, chunk) with halo rows.
    """
    window = frames(fps, config.evidence_window_seconds)
    lost = frames(fps, config.missing_confirmation_seconds)
    w = W.partitionBy("session_id", "_chunk", *by).orderBy("frame_idx")
    out = scored.withColumn("recent", recent_motion(w, window))
    lying = F.col("recent") & F.col("detected") & F.col("horizontal") & F.col("low")
    out = out.withColumn("_lying", lying).withColumn(
        "_mark", F.when(lying, F.lit(FALL_CANDIDATE)).when(F.col("motion"), F.lit(FALLING))
    )
    idle = F.when(F.col("detected"), F.lit(NORMAL)).otherwise(F.lit(UNKNOWN))
    gone = F.col("recent") & ~F.col("detected")
    return out.withColumns(
        {
            "open_state": F.when(F.col("recent"), F.last("_mark", True).over(w.rowsBetween(-window, 0))).otherwise(idle),
            "lost": F.sum(gone.cast("int")).over(w.rowsBetween(-(lost - 1), 0)) == lost,
        }
    ).drop("_mark")


def evidence_reach(fps: float, config: RuleConfig) -> int:
    return frames(fps, config.evidence_window_seconds) + frames(fps, config.missing_confirmation_seconds)


def first_fallen(found: DataFrame, fps: float, config: RuleConfig, by: Sequence[str] = ()) -> DataFrame:
    """Per session (and config) the first fallen frame; ``found`` holds core rows only."""
    step = F.when(
        F.col("recent"),
        F.when(F.col("_lying"), F.lit(1)).when(F.col("detected"), F.lit(-1)).otherwise(F.lit(0)),
    )
    walked = walk_in_chunk(found, ["session_id", "_chunk", *by], "frame_idx", step)
    # a walk only reaches the level on a lying frame, a lost run is recent by construction
    return walk_first_passage(
        walked, ["session_id", *by], "frame_idx", frames(fps, config.confirmation_seconds), F.col("lost")
    ).withColumnRenamed("first_hit", "first_fallen_frame")


def fall_evidence(
    keypoints: DataFrame, fps: float, frame_height: int, config: RuleConfig, threshold: float = 0.2
) -> DataFrame:
    """Core rows with inputs, score, predicates and pre-fall state, partitioned by (session, chunk)."""
    geometry = frame_geometry(keypoints, threshold)  # its exchange is shared by all that reads it
    series = features_with_halo(geometry, fps, frame_height, evidence_reach(fps, config))
    scored = fall_score(evidence_inputs(series), threshold_columns(config))
    return core(evidence(scored, fps, config))


def fall_states(
    keypoints: DataFrame, fps: float, frame_height: int, config: RuleConfig | None = None, threshold: float = 0.2
) -> DataFrame:
    """State and score of every frame."""
    config = config or RuleConfig()
    found = written(fall_evidence(keypoints, fps, frame_height, config, threshold), "evidence")  # read by both sides of the join
    falls = spread_to_chunks(first_fallen(found, fps, config), "_last")
    return (
        found.join(falls, ["session_id", "_chunk"])
        .withColumn(
            "state",
            F.when(F.col("frame_idx") >= F.col("first_fallen_frame"), F.lit(FALLEN)).otherwise(F.col("open_state")),
        )
        .drop("_chunk", "_lying", "open_state", "lost")
    )


def session_summary(
    keypoints: DataFrame, fps: float, frame_height: int, config: RuleConfig | None = None, threshold: float = 0.2
) -> DataFrame:
    """One row per session: verdict, first falling/fallen frame and the largest measurements.

    Reads chunk summaries only; the frames are never joined with a per-session value.
    """
    config = config or RuleConfig()
    found = fall_evidence(keypoints, fps, frame_height, config, threshold).select(
        "session_id", "_chunk", "frame_idx", "detected", "recent", "_lying", "lost", "motion", "score",
        "hip_speed", "head_speed", "torso_angle", "bbox_aspect",
    )
    found = written(found, "evidence")
    peaks = found.groupBy("session_id").agg(
        F.min(F.when(F.col("motion"), F.col("frame_idx"))).alias("first_falling_frame"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.max(F.greatest("hip_speed", "head_speed")), F.lit(0.0)).alias("max_downward_speed"),
        F.coalesce(F.max("torso_angle"), F.lit(0.0)).alias("max_torso_angle"),
        F.coalesce(F.max("bbox_aspect"), F.lit(0.0)).alias("max_bbox_aspect"),
    )
    falls = first_fallen(found, fps, config).select("session_id", "first_fallen_frame")
    return peaks.join(falls, "session_id").withColumns(
        {
            "predicted": F.when(F.col("first_fallen_frame").isNotNull(), F.lit("fall")).otherwise(F.lit("normal")),
            "first_fallen_seconds": F.col("first_fallen_frame") / F.lit(float(fps)),
        }
    )


def threshold_sweep(
    keypoints: DataFrame, fps: float, frame_height: int, configs: Sequence[RuleConfig], threshold: float = 0.2
) -> DataFrame:
    """First fallen frame of every session under every config.

    The feature series are computed once, with the reach of the longest windows; the configs fan out on the finished
    rows, inside the partitioning those rows already have.  Configs with equal windows share their window pass.
    """
    geometry = written(frame_geometry(keypoints, threshold), "geometry")
    reach = max(evidence_reach(fps, c) for c in configs)
    series = evidence_inputs(features_with_halo(geometry, fps, frame_height, reach)).select(
        "session_id", "_chunk", "_core", "frame_idx", "detected", "speed", "drop", "angle", "aspect", "low_hip"
    )
    by_windows: dict[tuple[float, ...], list[int]] = {}
    for i, c in enumerate(configs):
        by_windows.setdefault((c.evidence_window_seconds, c.confirmation_seconds, c.missing_confirmation_seconds), []).append(i)
    if len(by_windows) > 1:
        series = written(series, "series")
    swept = None
    for members in by_windows.values():
        options = [F.struct(F.lit(i).alias("config_id"), *[F.lit(asdict(configs[i])[t]).alias(t) for t in THRESHOLDS]) for i in members]
        scored = fall_score(series.select("*", F.inline(F.array(*options))), {t: F.col(t) for t in THRESHOLDS})
        shared = configs[members[0]]
        found = first_fallen(core(evidence(scored, fps, shared, ["config_id"])), fps, shared, ["config_id"]).drop("_last")
        swept = found if swept is None else swept.unionByName(found)
    return swept

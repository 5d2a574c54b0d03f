"""Model-input features, resampling, clips, rates, runs and ids of frame sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import written
from .chunks import (
    by_chunk, core, dense_index, halo, join_per_key, last_positions, reflected_walk, running_last, running_max_before,
)
from .quantiles import exact_percentiles


def legacy_features(keypoints: DataFrame, width: str, height: str) -> DataFrame:
    """Coordinates as a share of the image, invisible joints 0."""
    w, h = F.greatest(F.col(width).cast("double"), F.lit(1.0)), F.greatest(F.col(height).cast("double"), F.lit(1.0))
    seen = F.expr("x IS NOT NULL AND y IS NOT NULL AND c > 0")
    return keypoints.withColumn("_seen", seen).withColumns(
        {
            "x": F.when(F.col("_seen"), F.col("x") / w).otherwise(F.lit(0.0)),
            "y": F.when(F.col("_seen"), F.col("y") / h).otherwise(F.lit(0.0)),
            "c": F.when(F.col("_seen"), F.col("c")).otherwise(F.lit(0.0)),
        }
    ).drop("_seen")


def _body_frame(keypoints: DataFrame) -> DataFrame:
    """Per session the origin (early pelvis) and scale (torso length) that normalise it."""
    seen = F.expr("x IS NOT NULL AND y IS NOT NULL AND c > 0")

    def at(axis, joint):
        return F.max(F.when(seen & (F.col("joint") == joint), F.col(axis)))

    x, y = F.when(seen, F.col("x")), F.when(seen, F.col("y"))
    frames = keypoints.groupBy("session_id", "frame_idx").agg(
        F.sqrt(F.pow(at("x", 1) - at("x", 8), 2) + F.pow(at("y", 1) - at("y", 8), 2)).alias("torso"),
        at("x", 8).alias("px"),
        at("y", 8).alias("py"),
        F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("span"),
    )
    frames = written(frames, "body-frames")  # one narrow row per frame; all medians read these
    last = written(last_positions(frames, ["session_id"], "frame_idx"), "last-positions")
    # The early fifth of a session is known from its last position; the join is on the small side.
    early = last.select("session_id", "_last", F.greatest(F.bround((F.col("_last") + 1) * 0.2), F.lit(1.0)).alias("_early"))
    is_early = F.col("frame_idx") < F.col("_early")
    stacked = join_per_key(frames, early, ["session_id"], "frame_idx").select(
        "session_id",
        F.inline(
            F.array(
                F.struct(F.lit("torso").alias("series"), F.when(F.col("torso") > 1e-3, F.col("torso")).alias("v")),
                F.struct(F.lit("px").alias("series"), F.when(is_early, F.col("px")).alias("v")),
                F.struct(F.lit("py").alias("series"), F.when(is_early, F.col("py")).alias("v")),
                F.struct(F.lit("span").alias("series"), F.col("span").alias("v")),
            )
        ),
    ).where("v IS NOT NULL")
    med = exact_percentiles(stacked, ["session_id", "series"], "v", {"m": 0.5})

    def one(name):
        return F.max(F.when(F.col("series") == name, F.col("m")))

    known = med.groupBy("session_id").agg(
        one("torso").alias("torso"), one("px").alias("px"), one("py").alias("py"), one("span").alias("span")
    )
    known = written(known, "body-medians")
    found = last.join(known, "session_id", "left")
    # Sessions without an early pelvis fall back to the median of all their visible joints; most tables have none.
    lost = found.where("px IS NULL").select("session_id", "_last")
    if not lost.isEmpty():
        spare = join_per_key(keypoints.where(seen), lost, ["session_id"], "frame_idx").select(
            "session_id",
            F.inline(
                F.array(
                    F.struct(F.lit("ax").alias("series"), F.col("x").alias("v")),
                    F.struct(F.lit("ay").alias("series"), F.col("y").alias("v")),
                )
            ),
        )
        spare = exact_percentiles(spare, ["session_id", "series"], "v", {"m": 0.5}).groupBy("session_id").agg(
            one("ax").alias("ax"), one("ay").alias("ay")
        )
        found = found.join(spare, "session_id", "left")
    else:
        found = found.withColumns({c: F.lit(None).cast("double") for c in ("ax", "ay")})
    return found.select(
        "session_id", "_last",
        F.coalesce("px", "ax", F.lit(0.0)).alias("_ox"),
        F.coalesce("py", "ay", F.lit(0.0)).alias("_oy"),
        F.greatest(F.coalesce("torso", "span", F.lit(1.0)), F.lit(1e-3)).alias("_scale"),
    )


def pose_features(keypoints: DataFrame) -> DataFrame:
    """Joints relative to the early pelvis in torso lengths, clipped to +-8; unseen joints are 0."""
    seen = F.expr("x IS NOT NULL AND y IS NOT NULL AND c > 0")

    def norm(axis, origin):
        v = (F.col(axis) - F.col(origin)) / F.col("_scale")
        return F.when(F.col("_seen"), F.least(F.greatest(v, F.lit(-8.0)), F.lit(8.0))).otherwise(F.lit(0.0))

    body = written(_body_frame(keypoints), "body-frame")
    return (
        join_per_key(keypoints.withColumn("_seen", seen), body, ["session_id"], "frame_idx")
        .withColumns({"x": norm("x", "_ox"), "y": norm("y", "_oy"),
                      "c": F.when(F.col("_seen"), F.col("c")).otherwise(F.lit(0.0))})
        .drop("_seen", "_ox", "_oy", "_scale")
    )


ENGINEERED = (
    "hip_x", "hip_y", "head_x", "head_y", "torso_x", "torso_y", "box_width", "box_height", "aspect", "coverage",
    "hip_vx", "hip_vy", "head_vy",
)


def engineered_features(pose: DataFrame, parts: int = 25) -> DataFrame:
    """13 columns per frame from ``pose_features`` rows."""
    seen = F.col("c") > 0

    def at(axis, joint):
        return F.coalesce(F.max(F.when(F.col("joint") == joint, F.col(axis))), F.lit(0.0))

    x, y = F.when(seen, F.col("x")), F.when(seen, F.col("y"))
    f = pose.groupBy("session_id", "frame_idx").agg(
        at("x", 8).alias("hip_x"), at("y", 8).alias("hip_y"), at("x", 0).alias("head_x"), at("y", 0).alias("head_y"),
        (at("x", 1) - at("x", 8)).alias("torso_x"), (at("y", 1) - at("y", 8)).alias("torso_y"),
        F.coalesce(F.max(x) - F.min(x), F.lit(0.0)).alias("box_width"),
        F.coalesce(F.max(y) - F.min(y), F.lit(0.0)).alias("box_height"),
        (F.count_if(seen) / F.lit(float(parts))).alias("coverage"),
    )
    f = f.withColumn("aspect", F.col("box_width") / F.greatest(F.col("box_height"), F.lit(1e-3)))
    wide = halo(f, "frame_idx", 1, 1)
    w = by_chunk(["session_id"], "frame_idx")

    def slope(c):
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return (
            F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2)
            .when(after.isNotNull(), after - F.col(c))
            .when(before.isNotNull(), F.col(c) - before)
        )

    out = core(wide.withColumns({"hip_vx": slope("hip_x"), "hip_vy": slope("hip_y"), "head_vy": slope("head_y")}))
    # a single frame has no motion and is all zero
    alone = F.col("hip_vx").isNull()
    return out.select("session_id", "frame_idx", *[F.when(alone, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ENGINEERED])


FEATURE_SETS = {
    "legacy": lambda kp: legacy_features(kp.withColumns({"_w": F.lit(640), "_h": F.lit(480)}), "_w", "_h").drop("_w", "_h"),
    "pose": pose_features,
    "engineered": lambda kp: engineered_features(pose_features(kp)),
}


def resample_sequence(
    rows: DataFrame, values: Sequence[str], n: int, keys: Sequence[str] = ("session_id",), idx: str = "frame_idx"
) -> DataFrame:
    """Linear resampling of dense sequences to ``n`` steps.

    A frame knows from its key's last position which steps it serves, so rows meet one row per (key, chunk), not the steps
    that ask for them, and the two frames of a step are mostly added up where they are.  The rows are not sorted: the
    short side is hashed.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = list(keys)
    gaps = max(n - 1, 1)
    sizes = last_positions(rows, keys, idx)
    i, last = F.col(idx), F.greatest(F.col("_last"), F.lit(1))
    # the steps between the frame before and the frame after
    first = F.greatest(F.floor((i - 1) * F.lit(gaps) / last), F.lit(0)).cast("int")
    final = F.least(F.ceil((i + 1) * F.lit(gaps) / last), F.lit(n - 1)).cast("int")
    below = F.floor("_pos")
    weight = F.when(below == i, below + 1 - F.col("_pos")).when(below + 1 == i, F.col("_pos") - below)
    return (
        join_per_key(rows, sizes.withColumn("_to", F.col("_last")).hint("shuffle_hash"), keys, idx, "_to")
        .withColumns({"_a": first, "_b": final})
        .where("_a <= _b")
        .withColumn("step", F.explode(F.sequence("_a", "_b")))
        .withColumn("_pos", F.col("step") * F.col("_last") / F.lit(float(gaps)))
        .withColumn("_w", weight)
        .where("_w > 0")
        .groupBy(*keys, "step")
        .agg(*[F.sum(F.col("_w") * F.col(v)).alias(v) for v in values])
    )


def sliding_clips(rows: DataFrame, length: int, every: int) -> DataFrame:
    """Rows of each clip: the last ``length`` frames at every ``every``-th frame.

    A frame names the clips it belongs to, so no range join is needed.
    """
    i = F.col("frame_idx")
    first_end = F.ceil((i + 1) / F.lit(every)) * every - 1
    last_end = F.floor(F.least(i + F.lit(length), F.col("_last") + 1) / F.lit(every)) * every - 1
    return (
        join_per_key(rows, last_positions(rows, ["session_id"], "frame_idx").withColumn("_to", F.col("_last")), ["session_id"], "frame_idx", "_to")
        .withColumns({"_a": first_end, "_b": last_end})
        .where("_a <= _b")
        .withColumn("clip_end", F.explode(F.sequence("_a", "_b", F.lit(every).cast("bigint"))))
        .drop("_a", "_b", "_last")
    )


def classifier_hysteresis(scored: DataFrame, every: int, confirm: int, probability: float = 0.8) -> DataFrame:
    """Counter that climbs while probability and posture agree; alarm at ``confirm`` frames.

    ``scored`` holds the evaluated frames with dense ``eval_idx``, ``p``, ``angle`` and ``aspect``.
    """
    hit = (F.col("p") >= probability) & ((F.col("angle") >= 40.0) | (F.col("aspect") >= 0.70))
    step = F.when(F.coalesce(hit, F.lit(False)), F.lit(every)).otherwise(F.lit(-every))
    walked = reflected_walk(scored, ["session_id"], "eval_idx", step, "counter")
    return walked.withColumn("alarm", F.col("counter") >= confirm)


def estimate_fps(
    frames: DataFrame, seconds: Column, fallback: float, longest: float = 2.0, lowest: float = 1.0, highest: float = 60.0
) -> DataFrame:
    """1 / median frame interval per session, clipped; the fallback below five frames."""
    wide = halo(frames.select("session_id", "frame_idx", seconds.alias("_t")), "frame_idx", 1, 0)
    gap = F.col("_t") - F.lag("_t").over(by_chunk(["session_id"], "frame_idx"))
    gaps = core(wide.withColumn("_gap", gap)).where((F.col("_gap") > 0.001) & (F.col("_gap") < longest))
    med = exact_percentiles(gaps, ["session_id"], "_gap", {"_m": 0.5}).drop("n")
    return (
        last_positions(frames, ["session_id"], "frame_idx")
        .join(med, "session_id", "left")
        .select(
            "session_id",
            F.when(
                (F.col("_last") + 1 >= 5) & F.col("_m").isNotNull(),
                F.least(F.greatest(1.0 / F.col("_m"), F.lit(lowest)), F.lit(highest)),
            ).otherwise(F.lit(fallback)).alias("fps"),
        )
    )


def rolling_fps(frames: DataFrame, seconds: Column, window: int = 15) -> DataFrame:
    """Rate over the last ``window`` frames."""
    wide = halo(frames.withColumn("_t", seconds), "frame_idx", window - 1, 0)
    w = by_chunk(["session_id"], "frame_idx").rowsBetween(-(window - 1), 0)
    took = F.col("_t") - F.first("_t").over(w)
    n = F.count("*").over(w)
    return core(
        wide.withColumn("fps", (n - 1) / F.when(took != 0, took).otherwise(F.lit(1.0)))
    ).drop("_chunk", "_t")


def empty_runs(frames: DataFrame, empty: Column, alarm: int = 500) -> DataFrame:
    """Maximal runs of empty frames with their length; ``alarm`` marks runs that are too long."""
    marked = running_last(
        frames.select("session_id", "frame_idx", empty.alias("_empty")),
        ["session_id"], "frame_idx",
        {"_anchor": F.when(~F.col("_empty"), F.col("frame_idx"))},
    )
    return (
        marked.where("_empty")
        .groupBy("session_id", "_anchor")
        .agg(F.min("frame_idx").alias("first_frame"), F.count("*").alias("length"))
        .select("session_id", "first_frame", "length", (F.col("length") >= alarm).alias("too_long"))
    )


def assign_frame_ids(views: DataFrame, order: Sequence[str], bucket: Column, existing: str) -> DataFrame:
    """Consecutive ids, one per frame and shared by its views; ids already present stay."""
    heads = views.select("session_id", *order).distinct()
    ids = dense_index(heads, ["session_id"], list(order), bucket, "_id")
    return views.join(ids, ["session_id", *order]).withColumn("frame_id", F.coalesce(F.col(existing), F.col("_id"))).drop("_id")


def training_history_best(history: DataFrame, key: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """Best epoch by strictly greater metric and the epoch where patience runs out."""
    ahead = running_max_before(history, [key], epoch, F.col(metric), "_before")
    better = F.col(metric) > F.coalesce(F.col("_before"), F.lit(-1.0))
    tracked = running_last(
        ahead, [key], epoch, {"_best": F.when(better, F.struct(F.col(epoch).alias("e"), F.col(metric).alias("m")))}
    )
    stale = F.col(epoch) - F.coalesce(F.col("_best.e"), F.lit(-1)) >= patience
    return (
        tracked.groupBy(key)
        .agg(
            F.min(F.when(stale, F.col(epoch))).alias("stop_epoch"),
            F.min_by("_best", F.when(stale, F.col(epoch))).alias("_at_stop"),
            F.max_by("_best", epoch).alias("_at_end"),
        )
        .select(
            key, "stop_epoch",
            F.when(F.col("stop_epoch").isNotNull(), F.col("_at_stop.e")).otherwise(F.col("_at_end.e")).alias("best_epoch"),
            F.when(F.col("stop_epoch").isNotNull(), F.col("_at_stop.m")).otherwise(F.col("_at_end.m")).alias("best_metric"),
        )
    )


def profile_timings(rows: DataFrame, key: str, value: str, order: Sequence[str], bucket: Column, every: int) -> DataFrame:
    """Average of every ``every`` consecutive samples of a key, for complete groups."""
    numbered = dense_index(rows, [key], list(order), bucket, "_i")
    return (
        numbered.groupBy(key, F.floor(F.col("_i") / every).alias("batch"))
        .agg(F.avg(value).alias("average"), F.count("*").alias("_n"))
        .where(F.col("_n") == every)
        .drop("_n")
    )


def latency_summary(frames: DataFrame, value: str, seconds: Column) -> DataFrame:
    """Warm-up, median and 95th percentile of the rest, and average rate of each session."""
    whole = frames.groupBy("session_id").agg(
        F.min_by(value, "frame_idx").alias("warmup"),
        F.try_divide(F.count("*"), F.max(seconds) - F.min(seconds)).alias("average_fps"),
        F.count("*").alias("frames"),
    )
    steady = frames.where("frame_idx > 0")
    lone = whole.where("frames = 1").select("session_id", F.col("warmup").alias(value))
    steady = steady.select("session_id", value).unionByName(lone)
    q = exact_percentiles(steady, ["session_id"], value, {"median": 0.5, "p95": 0.95}).drop("n")
    return whole.join(q, "session_id")


def _uniform(*parts) -> Column:
    """Repeatable uniform in [0, 1) from the row's own keys, so a lost task redraws the same."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def augment_sequences(keypoints: DataFrame, steps: int, seed: int) -> DataFrame:
    """Crop to 85-100 %, mirror half of the sessions, add N(0, .01) noise, resample."""
    s = F.col("session_id")
    plan = last_positions(keypoints, ["session_id"], "frame_idx").select(
        "session_id",
        F.greatest(F.bround((F.col("_last") + 1) * (0.85 + 0.15 * _uniform(s, F.lit(seed)))), F.lit(2.0)).cast("bigint").alias("_len"),
        (F.col("_last") + 1).alias("_n"),
        (_uniform(s, F.lit(seed + 1)) < 0.5).alias("mirrored"),
    ).withColumn(
        "_start", F.floor(_uniform(s, F.lit(seed + 2)) * (F.greatest(F.col("_n") - F.col("_len"), F.lit(0)) + 1))
    )
    key = [F.col("session_id"), F.col("frame_idx"), F.col("joint")]

    def noise(k):
        u, v = _uniform(*key, F.lit(seed + k)), _uniform(*key, F.lit(seed + k + 1))
        return 0.01 * F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * 3.141592653589793 * v)

    cut = join_per_key(keypoints, plan.withColumn("_to", F.col("_n") - 1), ["session_id"], "frame_idx", "_to").where(
        (F.col("frame_idx") >= F.col("_start")) & (F.col("frame_idx") < F.col("_start") + F.col("_len"))
    )
    moved = cut.select(
        "session_id", "joint", "mirrored", "c",
        (F.when(F.col("mirrored"), -F.col("x")).otherwise(F.col("x")) + noise(3)).alias("x"),
        (F.col("y") + noise(5)).alias("y"),
        (F.col("frame_idx") - F.col("_start")).alias("frame_idx"),
    )
    return resample_sequence(moved, ["x", "y", "c"], steps, ["session_id", "joint", "mirrored"])

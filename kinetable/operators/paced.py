"""Features and fall states of sessions that each have their own frame rate and image height.

``sessions`` holds (session_id, fps, frame_height).  Seconds become frames row by row, so the width of a window is a column,
which no window frame takes.  But a frame of constant reach over a *scaled* order does the same: dividing the positions of a
session by its own width makes every width 1.  Half a step of slack keeps rounding away from the border::

    last w rows and this one   positions / (w + 1/2), one before to this
    the row k before           positions / k, one before give or take a millionth

All these orders follow the frames, so they need sorts inside the partitions and no further exchange.  Border rows are copied
to the next chunk by the reach of their own session.  Confirmation counts differ as well; the walk to them keeps the
positions of its records in each chunk, which answer for every count and every carry.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import written
from . import chunks
from .chunks import by_chunk, core, join_per_key, last_positions, spread_to_chunks, walk_in_chunk
from .detect import (
    FALL_CANDIDATE, FALLEN, FALLING, NORMAL, THRESHOLDS, UNKNOWN, RuleConfig, evidence_inputs, fall_score, threshold_columns,
)
from .geometry import frame_geometry
from .timeseries import SERIES

SCALE = 1_000_000
SESSION = ("session_id",)
#: Seconds of the windows.
SECONDS = {"_gap": 0.3, "_radius": 0.15, "_speed": 0.4, "_drop": 1.0, "_opening": 2.0, "_absent": 0.5}
RULE = {"_window": "evidence_window_seconds", "_confirm": "confirmation_seconds", "_lost": "missing_confirmation_seconds"}


def in_frames(seconds: float) -> Column:
    """Seconds in frames of the row's session, half to even, one at least."""
    return F.greatest(F.lit(1), F.rint(F.col("fps") * F.lit(float(seconds))).cast("int"))


def rule_widths(config: RuleConfig) -> dict[str, Column]:
    return {n: in_frames(getattr(config, f)) for n, f in RULE.items()}


def paces(sessions: DataFrame) -> DataFrame:
    """(session_id, fps, frame_height) and all widths of the features; a rate that isn't positive is an error."""
    fps = F.when(F.col("fps") > 0, F.col("fps").cast("double")).otherwise(F.raise_error(F.lit("fps must be positive")).cast("double"))
    return sessions.select("session_id", fps.alias("fps"), F.col("frame_height").cast("double").alias("frame_height")).select(
        "*", *[in_frames(s).alias(n) for n, s in SECONDS.items()]
    )


def with_paces(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frames with the pace of their session, joined by chunk; sessions without a pace drop out."""
    per_session = paces(sessions).join(last_positions(frames, SESSION, "frame_idx"), "session_id")
    return join_per_key(frames, per_session, SESSION, "frame_idx")


def paced_halo(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Border rows go to the chunks whose rows look at them; ``_at`` is the position relative to the chunk."""
    i = F.col("frame_idx")
    lo, hi = F.floor((i - after) / F.lit(chunks.CHUNK_ROWS)), F.floor((i + before) / F.lit(chunks.CHUNK_ROWS))
    wide = df.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
    return wide.withColumns({"_core": F.col("_chunk") == F.floor(i / F.lit(chunks.CHUNK_ROWS)), "_at": i - F.col("_chunk") * F.lit(chunks.CHUNK_ROWS)})


def _scaled(width: Column, by: Sequence[str]) -> W:
    return W.partitionBy("session_id", "_chunk", *by).orderBy(F.col("_at") * F.lit(float(SCALE)) / width)


def upto(width: str, by: Sequence[str] = (), less: int = 0) -> W:
    """The last ``width - less`` rows and this one."""
    return _scaled(F.col(width) + F.lit(0.5 - less), by).rangeBetween(-SCALE, 0)


def around(width: str) -> W:
    return _scaled(F.col(width) + F.lit(0.5), ()).rangeBetween(-SCALE, SCALE)


def change(value: str, width: str) -> Column:
    """``value`` minus the one ``width`` rows before."""
    w = _scaled(F.col(width), ()).rangeBetween(-SCALE - 1, -SCALE + 1)
    return F.col(value) - F.first(value).over(w)


def _median(values: Column) -> Column:
    ordered, n = F.sort_array(values), F.size(values)
    half = lambda k: F.try_element_at(ordered, F.floor(k).cast("int"))
    return F.when(n > 0, (half((n + 1) / 2) + half(n / 2 + 1)) / 2)


def smoothed(df: DataFrame, values: Sequence[str] = SERIES) -> DataFrame:
    """Short gaps filled linearly, then centred medians."""
    w = by_chunk(SESSION, "_at")
    past, ahead = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col("_at").alias("i"), F.col(v).alias("v"))) for v in values}
    df = df.withColumns({f"_k_{v}": k for v, k in known.items()})
    df = df.withColumns({f"_l_{v}": F.last(f"_k_{v}", True).over(past) for v in values} | {f"_r_{v}": F.first(f"_k_{v}", True).over(ahead) for v in values})

    def filled(v: str) -> Column:
        left, right = F.col(f"_l_{v}"), F.col(f"_r_{v}")
        span = right["i"] - left["i"]
        return F.coalesce(F.col(v), F.when(span - 1 <= F.col("_gap"), left["v"] + (right["v"] - left["v"]) * (F.col("_at") - left["i"]) / span))

    df = df.withColumns({v: filled(v) for v in values}).drop(*[f"_{k}_{v}" for v in values for k in "klr"])
    return df.withColumns({v: _median(F.collect_list(v).over(around("_radius"))) for v in values})


def reach() -> Column:
    """How far a smoothed value looks, in frames of the row's session."""
    return F.col("_gap") + F.col("_radius")


def paced_baseline(geometry: DataFrame) -> DataFrame:
    """Body height and hip level over the first two seconds of each session; ``geometry`` carries its paces."""
    opening = geometry.where(F.col("frame_idx") < F.col("_opening") + reach()).withColumns({"_chunk": F.lit(0).cast("bigint"), "_at": F.col("frame_idx")})
    early = F.col("frame_idx") < F.col("_opening")
    return (
        smoothed(opening, ["hip_y"])
        .groupBy("session_id", "frame_height")
        .agg(F.percentile(F.when(early, F.col("body_height")), 0.5).alias("_h"), F.percentile(F.when(early, F.col("hip_y")), 0.5).alias("_hip"))
        .select(
            "session_id",
            F.greatest(F.coalesce("_h", F.col("frame_height") * 0.5), F.col("frame_height") * 0.15).alias("baseline_body_height"),
            F.coalesce("_hip", F.col("frame_height") * 0.5).alias("baseline_hip_y"),
        )
    )


def _geometry(keypoints: DataFrame, sessions: DataFrame, threshold: float) -> DataFrame:
    slim = frame_geometry(keypoints, threshold).select("session_id", "frame_idx", "detected", "body_height", *SERIES)
    return written(with_paces(slim, sessions), "paced-geometry")


def _features(geometry: DataFrame, extra: Column) -> DataFrame:
    """All series on (session, chunk), right on ``extra`` rows before each chunk too."""
    wide = paced_halo(geometry.drop("body_height"), reach() + F.greatest("_speed", "_drop") + extra, reach())
    series = smoothed(wide)
    series = series.withColumns({f"_{p}_{n}": change(f"{p}_y", f"_{n}") for n in ("drop", "speed") for p in ("hip", "head")})
    base = paced_baseline(geometry).join(last_positions(geometry, SESSION, "frame_idx"), "session_id")
    h, rate = F.col("baseline_body_height"), F.col("fps") / F.col("_speed")
    # halo rows one chunk past the end are dropped by the join
    return series.join(spread_to_chunks(base, "_last"), ["session_id", "_chunk"]).withColumns(
        {f"{p}_drop": F.col(f"_{p}_drop") / h for p in ("hip", "head")} | {f"{p}_speed": F.col(f"_{p}_speed") / h * rate for p in ("hip", "head")}
    ).drop(*[f"_{p}_{n}" for p in ("hip", "head") for n in ("drop", "speed")])


def extract_features(keypoints: DataFrame, sessions: DataFrame, threshold: float = 0.2) -> DataFrame:
    """One row per frame with every series and the session baselines."""
    found = core(_features(_geometry(keypoints, sessions, threshold), F.lit(0)))
    return found.drop("_chunk", "_at", *SECONDS)


def evidence(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As ``detect.evidence``, with the widths of each row's session."""
    recent, w = upto("_window", by), upto("_lost", by, 1)
    out = scored.withColumn("recent", F.coalesce(F.max(F.col("motion").cast("int")).over(recent) == 1, F.lit(False)))
    lying = F.col("recent") & F.col("detected") & F.col("horizontal") & F.col("low")
    out = out.withColumn("_lying", lying).withColumn("_mark", F.when(lying, F.lit(FALL_CANDIDATE)).when(F.col("motion"), F.lit(FALLING)))
    idle = F.when(F.col("detected"), F.lit(NORMAL)).otherwise(F.lit(UNKNOWN))
    gone = F.col("recent") & ~F.col("detected")
    return out.withColumns({
        "open_state": F.when(F.col("recent"), F.last("_mark", True).over(recent)).otherwise(idle),
        "lost": F.sum(gone.cast("int")).over(w) == F.col("_lost"),
    }).drop("_mark")


def walk_first_passage(walked: DataFrame, keys: Sequence[str], idx: str, level: str, also: Column) -> DataFrame:
    """Per key the first position where the walk reaches the level of the key's rows (a column), or ``also`` holds.

    The sum of steps of at most 1 reaches each height first at a record, so the positions of a chunk's records up to the
    level say where it is reached from any carry.
    """
    keys = list(keys)
    earlier = W.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(W.unboundedPreceding, -1)
    top = F.greatest(F.lit(0), F.coalesce(F.max("_s").over(earlier), F.lit(0)))
    record = F.when((F.col("_s") > top) & (F.col("_s") <= F.col(level)), F.struct("_s", F.col(idx).alias("_i")))
    hit = (F.col("_lo") >= F.col(level)) | F.coalesce(also, F.lit(False))
    ends = walked.withColumn("_record", record).groupBy(*keys, "_chunk").agg(
        F.sort_array(F.collect_list("_record")).alias("_records"), F.min(F.when(hit, F.col(idx))).alias("_direct"),
        F.max_by("_s", idx).alias("_end_s"), F.max_by("_lo", idx).alias("_end_lo"), F.max(idx).alias("_end"), F.max(level).alias("_level"),
    ).withColumn("_end_s", F.when(F.col("_end_s") < -(1 << 19), F.lit(-(1 << 31))).otherwise(F.col("_end_s")))
    so_far = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    carry = F.coalesce(F.lag("_out").over(W.partitionBy(*keys).orderBy("_chunk")), F.lit(0))
    return (
        ends.withColumn("_t", F.sum("_end_s").over(so_far))
        .withColumn("_out", F.col("_t") + F.max(F.col("_end_lo") - F.col("_t")).over(so_far))
        .withColumn("_need", (F.col("_level") - F.least(carry, F.col("_level") - 1)).cast("int"))
        .withColumn("_carried", F.try_element_at("_records", F.col("_need"))["_i"])
        .groupBy(*keys).agg(F.min(F.least("_direct", "_carried")).alias("first_hit"), F.max("_end").alias("_last"))
    )


def first_fallen(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    step = F.when(F.col("recent"), F.when(F.col("_lying"), F.lit(1)).when(F.col("detected"), F.lit(-1)).otherwise(F.lit(0)))
    walked = walk_in_chunk(found, ["session_id", "_chunk", *by], "frame_idx", step)
    return walk_first_passage(walked, ["session_id", *by], "frame_idx", "_confirm", F.col("lost")).withColumnRenamed("first_hit", "first_fallen_frame")


def _evidence(keypoints: DataFrame, sessions: DataFrame, config: RuleConfig, threshold: float) -> DataFrame:
    """Core rows with everything that states and summaries read, written once."""
    widths = rule_widths(config)
    series = _features(_geometry(keypoints, sessions, threshold), widths["_window"] + widths["_lost"])
    scored = fall_score(evidence_inputs(series.withColumns(widths)), threshold_columns(config))
    return written(core(evidence(scored)).drop("_at", *SECONDS, "_window", "_lost"), "paced-evidence")


def fall_states(keypoints: DataFrame, sessions: DataFrame, config: RuleConfig | None = None, threshold: float = 0.2) -> DataFrame:
    """State and score of every frame, each session at its own rate and height."""
    found = _evidence(keypoints, sessions, config or RuleConfig(), threshold)
    falls = spread_to_chunks(first_fallen(found), "_last")
    state = F.when(F.col("frame_idx") >= F.col("first_fallen_frame"), F.lit(FALLEN)).otherwise(F.col("open_state"))
    return found.join(falls, ["session_id", "_chunk"]).withColumn("state", state).drop("_chunk", "_lying", "_confirm", "open_state", "lost")


def session_summary(keypoints: DataFrame, sessions: DataFrame, config: RuleConfig | None = None, threshold: float = 0.2) -> DataFrame:
    """One row per session: verdict, first falling / fallen frame (and seconds at its rate), largest measurements."""
    found = _evidence(keypoints, sessions, config or RuleConfig(), threshold)
    peaks = found.groupBy("session_id", "fps").agg(
        F.min(F.when(F.col("motion"), F.col("frame_idx"))).alias("first_falling_frame"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.max(F.greatest("hip_speed", "head_speed")), F.lit(0.0)).alias("max_downward_speed"),
        F.coalesce(F.max("torso_angle"), F.lit(0.0)).alias("max_torso_angle"),
        F.coalesce(F.max("bbox_aspect"), F.lit(0.0)).alias("max_bbox_aspect"),
    )
    return peaks.join(first_fallen(found).drop("_last"), "session_id").withColumns({
        "predicted": F.when(F.col("first_fallen_frame").isNotNull(), F.lit("fall")).otherwise(F.lit("normal")),
        "first_fallen_seconds": F.col("first_fallen_frame") / F.col("fps"),
    })


def threshold_sweep(keypoints: DataFrame, sessions: DataFrame, configs: Sequence[RuleConfig], threshold: float = 0.2) -> DataFrame:
    """First fallen frame of every session under every config; configs with equal windows share their pass."""
    widths = [rule_widths(c) for c in configs]
    farthest = F.greatest(*[w["_window"] + w["_lost"] for w in widths], F.lit(0))
    series = evidence_inputs(_features(_geometry(keypoints, sessions, threshold), farthest)).select(
        "session_id", "_chunk", "_core", "_at", "frame_idx", "fps", "detected", "speed", "drop", "angle", "aspect", "low_hip"
    )
    by_windows: dict[tuple[float, ...], list[int]] = {}
    for i, c in enumerate(configs):
        by_windows.setdefault(tuple(getattr(c, f) for f in RULE.values()), []).append(i)
    if len(by_windows) > 1:
        series = written(series, "paced-series")
    swept = None
    for members in by_windows.values():
        options = [F.struct(F.lit(i).alias("config_id"), *[F.lit(asdict(configs[i])[t]).alias(t) for t in THRESHOLDS]) for i in members]
        scored = fall_score(series.select("*", F.inline(F.array(*options))), {t: F.col(t) for t in THRESHOLDS})
        found = first_fallen(core(evidence(scored.withColumns(widths[members[0]]), ["config_id"])), ["config_id"]).drop("_last")
        swept = found if swept is None else swept.unionByName(found)
    return swept


def _held(df: DataFrame) -> DataFrame:
    """Values held over short gaps, then medians of the past."""
    df = df.withColumns({v: F.last(v, True).over(upto("_gap")) for v in SERIES})
    return df.withColumns({v: _median(F.collect_list(v).over(upto("_radius"))) for v in SERIES})


def frozen_baseline(geometry: DataFrame) -> DataFrame:
    """Calibration end and the baselines fixed there; ``geometry`` carries its paces."""
    body = F.min(F.when(F.col("body_height").isNotNull(), F.col("frame_idx")))
    closes = geometry.groupBy("session_id").agg(F.greatest(F.max("_opening") - 1, body).alias("calibrated_at"), F.count("body_height").alias("_seen"))
    closes = closes.where("_seen > 0").drop("_seen").withColumn("_last", F.col("calibrated_at"))  # no later chunk matters
    opening = core(_held(paced_halo(geometry, reach(), F.lit(0)))).drop("_chunk", "_at")
    return (
        join_per_key(opening, closes, SESSION, "frame_idx").where(F.col("frame_idx") <= F.col("calibrated_at"))
        .groupBy("session_id", "calibrated_at", "frame_height")
        .agg(F.percentile("body_height", 0.5).alias("_h"), F.percentile("hip_y", 0.5).alias("_hip"))
        .select(
            "session_id", "calibrated_at", F.greatest("_h", F.col("frame_height") * 0.15).alias("baseline_body_height"),
            F.coalesce("_hip", F.col("frame_height") * 0.5).alias("baseline_hip_y"),
        )
    )


def causal_fall_states(keypoints: DataFrame, sessions: DataFrame, config: RuleConfig | None = None, threshold: float = 0.2) -> DataFrame:
    """As ``causal.causal_fall_states``: what a live detector of each session's rate and height sees."""
    config = config or RuleConfig()
    geometry = _geometry(keypoints, sessions, threshold)
    widths = rule_widths(config)
    before = reach() + F.greatest("_speed", "_drop") + widths["_window"] * 2 + widths["_lost"] + F.col("_absent")
    series = _held(paced_halo(geometry.drop("body_height"), before, F.lit(0)))
    series = series.withColumns({f"_{p}_{n}": change(f"{p}_y", f"_{n}") for n in ("drop", "speed") for p in ("hip", "head")}).withColumns(widths)
    base = last_positions(geometry, SESSION, "frame_idx").join(frozen_baseline(geometry), "session_id", "left")
    joined = series.join(spread_to_chunks(base, "_last"), ["session_id", "_chunk"])
    live = F.coalesce(F.col("frame_idx") > F.col("calibrated_at"), F.lit(False))
    rate = {"drop": F.lit(1.0), "speed": F.col("fps") / F.col("_speed")}
    measured = joined.withColumn("_live", live).withColumns(
        {f"{p}_{n}": F.when(live, F.col(f"_{p}_{n}") / F.col("baseline_body_height") * rate[n]) for p in ("hip", "head") for n in ("drop", "speed")}
    )
    scored = fall_score(evidence_inputs(measured), threshold_columns(config)).withColumns(
        {"low_hip": F.when(F.col("_live"), F.col("low_hip")).otherwise(F.lit(0.0)), "motion": F.col("_live") & F.col("motion")}
    )
    scored = scored.withColumn("recent", F.coalesce(F.max(F.col("motion").cast("int")).over(upto("_window")) == 1, F.lit(False)))
    scored = scored.withColumn("_lying", F.col("recent") & F.col("detected") & F.col("horizontal") & F.col("low"))
    unseen = F.sum((F.col("_live") & ~F.col("detected")).cast("int")).over(upto("_absent", (), 1))
    mark = (
        F.when(F.col("frame_idx") == F.col("calibrated_at"), NORMAL).when(F.col("_lying"), FALL_CANDIDATE).when(F.col("motion"), FALLING)
        .when(F.col("_live") & ~F.col("recent") & F.col("detected"), NORMAL)
        .when(F.col("_live") & ~F.col("recent") & (unseen == F.col("_absent")), UNKNOWN)
    )
    missing = F.col("recent") & ~F.col("detected")
    scored = scored.withColumns({"_mark": mark, "_both": F.col("_window") + F.col("_absent")}).withColumns({
        "open_state": F.coalesce(F.last("_mark", True).over(upto("_both")), F.lit(UNKNOWN)),
        "lost": F.sum(missing.cast("int")).over(upto("_lost", (), 1)) == F.col("_lost"),
    })
    names = ["detected", "recent", "_lying", "open_state", "lost", "score", "speed", "drop", "angle", "aspect", "low_hip", "calibrated_at", "_live", "_confirm"]
    found = written(core(scored).select("session_id", "_chunk", "frame_idx", *names), "paced-causal")
    falls = spread_to_chunks(first_fallen(found), "_last")
    calibrated = F.coalesce(F.col("frame_idx") >= F.col("calibrated_at"), F.lit(False))
    down = F.coalesce(F.col("frame_idx") >= F.col("first_fallen_frame"), F.lit(False))
    posture = F.least(F.col("angle") / config.min_torso_angle, F.lit(2.0)) * 0.15 + F.least(F.col("aspect") / config.min_bbox_aspect, F.lit(2.0)) * 0.10
    return found.join(falls, ["session_id", "_chunk"]).select(
        "session_id", "frame_idx", F.when(down, FALLEN).otherwise(F.col("open_state")).alias("state"), down.alias("fall_latched"),
        (~calibrated).alias("calibrating"), "detected",
        F.when(F.col("_live"), F.col("score")).when(calibrated, posture).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("_live"), F.col("speed")).otherwise(F.lit(0.0)).alias("downward_speed"),
        F.when(F.col("_live"), F.col("drop")).otherwise(F.lit(0.0)).alias("drop"),
        F.col("angle").alias("torso_angle"), F.col("aspect").alias("bbox_aspect"), "low_hip",
    )

"""Per-person boxes, selection, scaling and matching on long multi-person keypoints.

Rows are (session_id, frame_idx, person_idx, joint, x, y, c).  Everything groups by frame or
person with mergeable aggregates, so no frame has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import half_up
from ..scratch import written
from .chunks import join_per_key

PERSON = ("session_id", "frame_idx", "person_idx")
FRAME = ("session_id", "frame_idx")

# Joints of the 25-part skeleton used by the box estimators.
L_HAND = (7, 6, 5)  # wrist, elbow, shoulder
R_HAND = (4, 3, 2)
FACE = {"neck": 1, "nose": 0, "lear": 18, "rear": 17, "leye": 16, "reye": 15}

# 17-part source joint -> 25-part joint.
PARTS_17_TO_25 = {
    0: 0, 1: 16, 2: 15, 3: 18, 4: 17, 5: 5, 6: 2, 7: 6, 8: 3, 9: 7, 10: 4, 11: 12, 12: 9, 13: 13, 14: 10, 15: 14, 16: 11,
}
NECK_FROM, MID_HIP_FROM = (5, 6), (11, 12)


def person_box(people: DataFrame, threshold: float, first: int = 0, last: int | None = None, keys=PERSON) -> DataFrame:
    """Bounding box over joints ``[first, last)`` scoring above ``threshold``; zero box if none."""
    use = F.col("c") > threshold
    use = use & (F.col("joint") >= first)
    if last is not None:
        use = use & (F.col("joint") < last)
    x, y = F.when(use, F.col("x")), F.when(use, F.col("y"))
    zero = F.lit(0.0)
    return people.groupBy(*keys).agg(
        F.coalesce(F.min(x), zero).alias("box_x"),
        F.coalesce(F.min(y), zero).alias("box_y"),
        F.coalesce(F.max(x) - F.min(x), zero).alias("box_w"),
        F.coalesce(F.max(y) - F.min(y), zero).alias("box_h"),
    )


def person_stats(people: DataFrame, threshold: float, limb: tuple[int, int]) -> DataFrame:
    """Average score, box area, count of joints at or above the threshold and one limb length."""

    def at(axis, joint):
        return F.max(F.when(F.col("joint") == joint, F.col(axis)))

    use = F.col("c") > threshold
    x, y = F.when(use, F.col("x")), F.when(use, F.col("y"))
    a, b = limb
    return people.groupBy(*PERSON).agg(
        F.avg("c").alias("avg_score"),
        F.coalesce((F.max(x) - F.min(x)) * (F.max(y) - F.min(y)), F.lit(0.0)).alias("area"),
        F.count_if(F.col("c") >= threshold).alias("n_joints"),
        F.sqrt(F.pow(at("x", a) - at("x", b), 2) + F.pow(at("y", a) - at("y", b), 2)).alias("limb"),
    )


def best_person(per_person: DataFrame, rank: Column) -> DataFrame:
    """Per frame the person with the largest rank, the earlier one on ties.  Partial maxima only."""
    return per_person.groupBy(*FRAME).agg(
        F.max_by("person_idx", F.struct(rank, -F.col("person_idx"))).alias("person_idx")
    )


def select_person_conf(people: DataFrame, frames: DataFrame, joints: int) -> DataFrame:
    """Each frame's person of highest mean confidence, one row per joint; unseen joints are NULL
    with confidence 0 and a frame without people still gives its ``joints`` empty rows.

    The joints of a person travel as one bounded array, so the choice needs no join back.
    """
    person = people.groupBy(*PERSON).agg(
        F.avg("c").alias("_mean"),
        F.map_from_entries(F.collect_list(F.struct("joint", F.struct("x", "y", "c")))).alias("_kps"),
    )
    chosen = person.groupBy(*FRAME).agg(
        F.max_by("_kps", F.struct("_mean", -F.col("person_idx"))).alias("_kps")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(joints - 1)))
    k = F.col("_k")
    return (
        frames.join(chosen, list(FRAME), "left")
        .select(*FRAME, "_kps", every.alias("joint"))
        .withColumn("_k", F.try_element_at("_kps", F.col("joint")))
        .select(
            *FRAME,
            "joint",
            F.when(k["c"] > 0, k["x"]).alias("x"),
            F.when(k["c"] > 0, k["y"]).alias("y"),
            F.coalesce(k["c"], F.lit(0.0)).alias("c"),
        )
    )


def select_person_size(people: DataFrame) -> DataFrame:
    """Per frame the person maximising box size x mean confidence x share of confident joints."""
    scored = people.groupBy(*PERSON).agg(
        (
            F.greatest(F.max("x") - F.min("x"), F.lit(1.0))
            * F.greatest(F.max("y") - F.min("y"), F.lit(1.0))
            * F.avg("c")
            * F.avg((F.col("c") > 0.2).cast("double"))
        ).alias("size_score")
    )
    return scored.groupBy(*FRAME).agg(
        F.max_by("person_idx", F.struct("size_score", -F.col("person_idx"))).alias("person_idx"),
        F.max("size_score").alias("size_score"),
    )


def remap_skeleton(people: DataFrame) -> DataFrame:
    """17-part joints to the 25-part layout; neck and mid hip are weighted midpoints.

    Every source joint is sent to the target joints it feeds and one aggregation finishes both
    plain copies and midpoints; joint 0 also opens the parts nothing maps to.
    """
    feeds = {s: [d] for s, d in PARTS_17_TO_25.items()}
    for s in NECK_FROM:
        feeds[s].append(1)
    for s in MID_HIP_FROM:
        feeds[s].append(8)
    mapped = {d for ds in feeds.values() for d in ds}
    open_parts = [p for p in range(25) if p not in mapped]
    arms = F.create_map(
        *[v for s, ds in feeds.items() for v in (F.lit(s), F.array(*[F.lit(d) for d in ds + (open_parts if s == 0 else [])]))]
    )
    sent = people.withColumn("_part", F.explode(arms[F.col("joint")]))
    seen = ~F.col("_part").isin(*open_parts) & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("c") > 0)
    w = F.when(seen, F.col("c"))
    return sent.groupBy(*PERSON, F.col("_part").alias("joint")).agg(
        (F.sum(F.col("x") * w) / F.sum(w)).alias("x"),
        (F.sum(F.col("y") * w) / F.sum(w)).alias("y"),
        F.coalesce(F.avg(w), F.lit(0.0)).alias("c"),
    )


SCALE_MODES = ("input", "net_output", "output", "unit", "unit_fixed", "signed", "signed_fixed")


def scale_keypoints(
    df: DataFrame, mode: str, width: str, height: str, to_output: float, net_to_output: float
) -> DataFrame:
    """Map x, y by the row's mode; unit ranges divide by size - 1 (NULL at size 1)."""
    m, w, h = F.col(mode), F.col(width) - 1.0, F.col(height) - 1.0
    long = F.greatest(w, h)

    def pick(across):
        return (
            F.when(m == "output", F.lit(to_output))
            .when(m == "net_output", F.lit(1.0 / net_to_output))
            .when(m == "unit", F.try_divide(F.lit(1.0), across))
            .when(m == "unit_fixed", F.try_divide(F.lit(1.0), long))
            .when(m == "signed", F.try_divide(F.lit(2.0), across))
            .when(m == "signed_fixed", F.try_divide(F.lit(2.0), long))
            .when(m == "input", F.lit(1.0))
            .otherwise(F.raise_error(F.concat(F.lit("unknown scale mode "), m)).cast("double"))
        )

    shift = F.when(m.isin("signed", "signed_fixed"), F.lit(-1.0)).otherwise(F.lit(0.0))
    return df.withColumns({"x": F.col("x") * pick(w) + shift, "y": F.col("y") * pick(h) + shift})


def scale_uniform(df: DataFrame, factor: float, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    return df.withColumns({a: F.col(a) * factor for a in axes})


def joint_columns(people: DataFrame, joints: Sequence[int]) -> DataFrame:
    """The named joints of each person side by side: columns x<j>, y<j>, c<j>."""
    return (
        people.where(F.col("joint").isin(*joints))
        .groupBy(*PERSON)
        .agg(*[F.max(F.when(F.col("joint") == j, F.col(a))).alias(f"{a}{j}") for j in joints for a in "xyc"])
    )


def _dist(a: int, b: int) -> Column:
    return F.sqrt(F.pow(F.col(f"x{a}") - F.col(f"x{b}"), 2) + F.pow(F.col(f"y{a}") - F.col(f"y{b}"), 2))


def hand_boxes(people: DataFrame, threshold: float = 0.03) -> DataFrame:
    """Square box beyond each wrist; zero box unless wrist, elbow and shoulder are seen."""

    def box(side, joints):
        w, e, s = joints
        ok = (F.col(f"c{w}") > threshold) & (F.col(f"c{e}") > threshold) & (F.col(f"c{s}") > threshold)
        size = 1.5 * F.greatest(_dist(w, e), 0.9 * _dist(e, s))

        def corner(a):
            tip = F.col(f"{a}{w}") + 0.33 * (F.col(f"{a}{w}") - F.col(f"{a}{e}"))
            return F.coalesce(F.when(ok, tip - size / 2), F.lit(0.0))

        side_len = F.coalesce(F.when(ok, size), F.lit(0.0))
        return F.struct(
            F.lit(side).alias("side"), corner("x").alias("box_x"), corner("y").alias("box_y"),
            side_len.alias("box_w"), side_len.alias("box_h"),
        )

    wide = joint_columns(people, [*L_HAND, *R_HAND])
    return wide.select(*PERSON, F.inline(F.array(box("left", L_HAND), box("right", R_HAND))))


def face_boxes(people: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Square face box: mean of up to three size and centre estimates; zero if none applies."""
    j = FACE
    wide = joint_columns(people, sorted(j.values()))
    up = {n: F.coalesce(F.col(f"c{p}") > threshold, F.lit(False)) for n, p in j.items()}

    def mid(axis, *names):
        return sum((F.col(f"{axis}{j[n]}") for n in names[1:]), F.col(f"{axis}{j[names[0]]}")) / float(len(names))

    def d(a, b):
        return _dist(j[a], j[b])

    head = up["neck"] & up["nose"]
    profile = (up["leye"] == up["lear"]) & (up["reye"] == up["rear"]) & (up["leye"] != up["reye"])
    zero = F.lit(0.0)

    def estimate(axis):
        first = F.when(
            head,
            F.when(profile & up["leye"], mid(axis, "leye", "lear", "nose"))
            .when(profile, mid(axis, "reye", "rear", "nose"))
            .otherwise(mid(axis, "neck", "nose")),
        ).otherwise(zero)
        return (
            first
            + F.when(up["leye"] & up["reye"], mid(axis, "leye", "reye")).otherwise(zero)
            + F.when(up["lear"] & up["rear"], mid(axis, "lear", "rear")).otherwise(zero)
        )

    size = (
        F.when(
            head,
            F.when(profile & up["leye"], 0.85 * (d("nose", "leye") + d("nose", "lear") + d("neck", "nose")))
            .when(profile, 0.85 * (d("nose", "reye") + d("nose", "rear") + d("neck", "nose")))
            .otherwise(2.0 * d("neck", "nose")),
        ).otherwise(zero)
        + F.when(up["leye"] & up["reye"], 3.0 * d("leye", "reye")).otherwise(zero)
        + F.when(up["lear"] & up["rear"], 2.0 * d("lear", "rear")).otherwise(zero)
    )
    n = head.cast("int") + (up["leye"] & up["reye"]).cast("int") + (up["lear"] & up["rear"]).cast("int")
    n = F.greatest(n, F.lit(1))
    return (
        wide.select(*PERSON, (size / n).alias("box_w"), (estimate("x") / n).alias("_x"), (estimate("y") / n).alias("_y"))
        .select(
            *PERSON,
            (F.col("_x") - F.col("box_w") / 2).alias("box_x"),
            (F.col("_y") - F.col("box_w") / 2).alias("box_y"),
            "box_w",
            F.col("box_w").alias("box_h"),
        )
    )


def recenter_box(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Same centre, new size."""
    return boxes.withColumns(
        {
            "box_x": F.col("box_x") + F.col("box_w") / 2 - width / 2,
            "box_y": F.col("box_y") + F.col("box_h") / 2 - height / 2,
            "box_w": width,
            "box_h": height,
        }
    )


def backproject_affine(peaks: DataFrame, affine: DataFrame, on: Sequence[str]) -> DataFrame:
    """Crop-space x, y to image space with the row-major 2x3 matrix columns m00..m12 of ``affine``."""
    x, y = F.col("x"), F.col("y")
    return (
        peaks.join(affine, list(on))
        .withColumns(
            {
                "x": F.col("m00") * x + F.col("m01") * y + F.col("m02"),
                "y": F.col("m10") * x + F.col("m11") * y + F.col("m12"),
            }
        )
        .drop("m00", "m01", "m02", "m10", "m11", "m12")
    )


def infer_frame_size(keypoints: DataFrame, default: tuple[int, int] = (640, 480)) -> DataFrame:
    def edge(axis, fallback):
        return F.coalesce(F.greatest(F.floor(F.max(axis)).cast("bigint") + 1, F.lit(1).cast("bigint")), F.lit(fallback).cast("bigint"))

    return keypoints.groupBy("session_id").agg(
        edge("x", default[0]).alias("frame_width"), edge("y", default[1]).alias("frame_height")
    )


def usable_sequences(rows: DataFrame, minimum: int = 15, key: str = "session_id") -> DataFrame:
    """Rows of keys with enough rows; the keys are counted in the tasks first, and written, so that the join reads two plain inputs."""
    long = written(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).select(key), "usable")
    return rows.join(long, key, "left_semi")


def frame_range(rows: DataFrame, first: int, last: int, step: int, idx: str = "frame_idx") -> DataFrame:
    if last < first:
        raise ValueError(f"last frame {last} is before first frame {first}")
    if step < 1:
        raise ValueError("step must be at least 1")
    return rows.where(F.col(idx).between(first, last) & ((F.col(idx) - first) % step == 0))


def progress_sample(rows: DataFrame, totals: DataFrame, every: float, idx: str = "frame_idx") -> DataFrame:
    """First, last and every k-th frame; ``every`` below 1 is a fraction of the session."""
    i, n = F.col(idx), F.col("n_frames")
    k = F.greatest(F.floor(n * every + 0.5), F.lit(1)) if every < 1 else F.lit(int(every + 0.5))
    totals = totals.select("session_id", "n_frames", (F.col("n_frames") - 1).alias("_to"))
    return join_per_key(rows, totals, ["session_id"], idx, "_to").where(
        (i == 0) | (i >= n - 1) | (F.pmod(i + 1, k) == 0)
    )


CELL = 256.0


def overlapping_pairs(
    a: DataFrame, b: DataFrame, on: Sequence[str], left: Sequence[str], right: Sequence[str], slack: float = 0.0
) -> DataFrame:
    """Pairs of boxes that touch, by an equi-join on image cells instead of all pairs of a group.

    Boxes are (box_x, box_y, box_w, box_h), grown by ``slack`` on every side.  A pair is reported only by the
    cell holding the corner of its intersection, so no distinct is needed.
    """

    def cells(df, tag, ids):
        lo_x, lo_y = F.col("box_x") - slack, F.col("box_y") - slack
        hi_x, hi_y = F.col("box_x") + F.col("box_w") + slack, F.col("box_y") + F.col("box_h") + slack
        out = df.select(
            *on, *[F.col(i).alias(f"{i}_{tag}") for i in ids],
            lo_x.alias(f"x0_{tag}"), lo_y.alias(f"y0_{tag}"), hi_x.alias(f"x1_{tag}"), hi_y.alias(f"y1_{tag}"),
        )
        span = lambda p, q: F.sequence(F.floor(F.col(p) / CELL), F.floor(F.col(q) / CELL))
        return out.withColumn("_cx", F.explode(span(f"x0_{tag}", f"x1_{tag}"))).withColumn(
            "_cy", F.explode(span(f"y0_{tag}", f"y1_{tag}"))
        )

    ix, iy = F.greatest("x0_a", "x0_b"), F.greatest("y0_a", "y0_b")
    return (
        cells(a, "a", left)
        .join(cells(b, "b", right), [*on, "_cx", "_cy"])
        .where((F.floor(ix / CELL) == F.col("_cx")) & (F.floor(iy / CELL) == F.col("_cy")))
        .withColumn("_iw", F.least("x1_a", "x1_b") - ix)
        .withColumn("_ih", F.least("y1_a", "y1_b") - iy)
        .where("_iw > 0 AND _ih > 0")
        .drop("_cx", "_cy")
    )


def person_iou(boxes: DataFrame) -> DataFrame:
    """IoU of the people of a frame; pairs that do not overlap have IoU 0 and no row."""
    real = boxes.where("box_w > 0 AND box_h > 0")
    pairs = overlapping_pairs(real, real, list(FRAME), ["person_idx"], ["person_idx"]).where(
        "person_idx_a < person_idx_b"
    )
    area = lambda t: (F.col(f"x1_{t}") - F.col(f"x0_{t}")) * (F.col(f"y1_{t}") - F.col(f"y0_{t}"))
    inter = F.col("_iw") * F.col("_ih")
    return pairs.select(
        *FRAME,
        F.col("person_idx_a").alias("person_a"),
        F.col("person_idx_b").alias("person_b"),
        (inter / (area("a") + area("b") - inter)).alias("iou"),
    )


def person_distance(a: DataFrame, b: DataFrame, on: Sequence[str], threshold: float) -> DataFrame:
    """Mean joint distance over joints at or above the threshold in both; NULL without any."""
    bb = b.select(*on, "joint", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("c").alias("_c"))
    both = (F.col("c") >= threshold) & (F.col("_c") >= threshold)
    d = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    return a.join(bb, [*on, "joint"]).groupBy(*on).agg(F.avg(F.when(both, d)).alias("distance"))


def confident_hands(hands: DataFrame, score: float = 0.66667, joint: float = 0.25) -> DataFrame:
    """Boxes of hand keypoints (with ``side``) whose average score is high enough."""
    keys = [*PERSON, "side"]
    use = F.col("c") > joint
    x, y = F.when(use, F.col("x")), F.when(use, F.col("y"))
    return (
        hands.groupBy(*keys)
        .agg(
            F.avg("c").alias("_avg"), F.min(x).alias("box_x"), F.min(y).alias("box_y"),
            (F.max(x) - F.min(x)).alias("box_w"), (F.max(y) - F.min(y)).alias("box_h"),
        )
        .where((F.col("_avg") > score) & (F.col("box_w") * F.col("box_h") > 0))
        .drop("_avg")
    )


def track_hand_boxes(boxes: DataFrame, previous: DataFrame) -> DataFrame:
    """Blend each hand box with the best overlapping confident box of the frame before."""
    keys = [*PERSON, "side"]
    prior = previous.withColumn("frame_idx", F.col("frame_idx") + 1)
    now = boxes.where("box_w * box_h > 0")
    pairs = overlapping_pairs(now, prior, [*FRAME, "side"], ["person_idx"], ["person_idx"], slack=0.5)
    area = lambda t: (F.col(f"x1_{t}") - F.col(f"x0_{t}") - 1.0) * (F.col(f"y1_{t}") - F.col(f"y0_{t}") - 1.0)
    ratio = F.least(F.lit(1.0), F.col("_iw") * F.col("_ih") / F.least(area("a"), area("b")))
    best = (
        pairs.withColumn("_ratio", ratio)
        .groupBy(*FRAME, "side", F.col("person_idx_a").alias("person_idx"))
        .agg(
            F.max_by(
                F.struct(
                    (F.col("x0_b") + 0.5).alias("px"), (F.col("y0_b") + 0.5).alias("py"),
                    (F.col("x1_b") - F.col("x0_b") - 1.0).alias("pw"),
                ),
                F.struct("_ratio", -F.col("person_idx_b")),
            ).alias("_p")
        )
    )
    p = F.col("_p")
    size = F.greatest((F.col("box_w") * 2.0 + p["pw"]) * 0.5, (F.col("box_h") * 2.0 + p["pw"]) * 0.5)
    half = 0.5 * (F.col("box_w") + p["pw"])
    return (
        boxes.join(best, keys, "left")
        .withColumn("_size", size)
        .select(
            *keys,
            F.coalesce(0.5 * (F.col("box_x") + p["px"] + half - F.col("_size")), F.col("box_x")).alias("box_x"),
            F.coalesce(0.5 * (F.col("box_y") + p["py"] + half - F.col("_size")), F.col("box_y")).alias("box_y"),
            F.coalesce(F.col("_size"), F.col("box_w")).alias("box_w"),
            F.coalesce(F.col("_size"), F.col("box_h")).alias("box_h"),
            p.isNotNull().alias("tracked"),
        )
    )


def merge_best_keypoint(a: DataFrame, b: DataFrame, on: Sequence[str], margin: float = 0.05) -> DataFrame:
    """A's joints, replaced by B's where B is more confident by over ``margin``."""
    bb = b.select(*on, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("c").alias("_c"))
    take = F.coalesce(F.col("_c") - F.col("c") > margin, F.lit(False))
    return (
        a.join(bb, list(on), "left")
        .withColumn("replaced", take)
        .withColumns({n: F.when(F.col("replaced"), F.col(f"_{n}")).otherwise(F.col(n)) for n in "xyc"})
        .drop("_x", "_y", "_c")
    )


def blend_tracked(predicted: DataFrame, observed: DataFrame, on: Sequence[str], confidence: float) -> DataFrame:
    """Tracked joints after an observation; ``on`` identifies frame, identity and joint.

    Identities the observation lacks disappear, new ones enter unchanged.  The prediction holds
    whole pixels.
    """
    pp = predicted.select(*on, F.bround("x").alias("_px"), F.bround("y").alias("_py"), F.lit(True).alias("_known"))
    ox, oy = half_up(F.col("x")), half_up(F.col("y"))
    d = F.sqrt(F.pow(F.col("_px") - ox, 2) + F.pow(F.col("_py") - oy, 2))
    active = F.col("c") >= confidence

    def blend(pred, obs, raw):
        merged = F.when(d < 5, pred).when(d < 10, half_up((pred + obs) / 2.0)).otherwise(obs)
        known = F.when(active, merged.cast("double")).otherwise(pred)
        return F.when(F.col("_known"), known).otherwise(raw)

    return (
        observed.join(pp, list(on), "left")
        .withColumn("active", active)
        .withColumns({"x": blend(F.col("_px"), ox, F.col("x")), "y": blend(F.col("_py"), oy, F.col("y"))})
        .drop("_px", "_py", "_known")
    )


def keep_top_people(per_person: DataFrame, n: int) -> DataFrame:
    """The N best people of each frame by score x sqrt(area); earlier person first on ties.

    ``row_number() <= n`` is limited inside each task before the exchange.
    """
    w = W.partitionBy(*FRAME).orderBy(F.desc("rank_score"), "person_idx")
    ranked = per_person.withColumn("rank_score", F.col("score") * F.sqrt("area"))
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

"""Raster peaks, limb scores, greedy matching and person assembly.

Frames are independent, so the unit of work is a frame (and part or limb); rasters are cut into
chunks of cells like long sessions are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import clamp, half_up
from .chunks import by_chunk, core, halo

FRAME = ("session_id", "frame_idx")
CELL_KEYS = (*FRAME, "part")


def grid_peaks(grid: DataFrame, width: int, height: int, threshold: float, max_peaks: int) -> DataFrame:
    """Local maxima of dense rasters, the first ``max_peaks`` of a part in raster order.

    Cells in raster order are a dense sequence, so the eight neighbours are fixed offsets: one
    exchange and one sort.  Only cells off the outer ring compare strictly; the first inner ring
    also accepts ties.
    """
    idx = F.col("cy").cast("bigint") * width + F.col("cx")
    wide = halo(grid.withColumn("_cell", idx), "_cell", width + 1, width + 1)
    w = by_chunk(CELL_KEYS, "_cell")
    x, y, v = F.col("cx"), F.col("cy"), F.col("v")
    strict, loose = F.lit(True), F.lit(True)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dx == dy == 0:
                continue
            step = dy * width + dx
            near = (F.lag if step < 0 else F.lead)("v", abs(step)).over(w)
            inside = (x + dx >= 0) & (x + dx < width) & (y + dy >= 0) & (y + dy < height)
            strict = strict & (v > near)
            loose = loose & F.when(inside, v >= near).otherwise(F.lit(True))
    deep = x.between(2, width - 3) & y.between(2, height - 3)
    ring = x.isin(1, width - 2) | y.isin(1, height - 2)
    found = core(wide.withColumn("_peak", (v > threshold) & F.when(deep, strict).when(ring, loose).otherwise(F.lit(False))))
    order = W.partitionBy(*CELL_KEYS).orderBy("_cell")
    return (
        found.where("_peak")
        .withColumn("peak_idx", F.row_number().over(order) - 1)
        .where(F.col("peak_idx") < max_peaks)
        .select(*CELL_KEYS, "peak_idx", "cy", "cx", "v")
    )


def refine_peaks(peaks: DataFrame, grid: DataFrame, offset: tuple[float, float] = (0.5, 0.5), reach: int = 3) -> DataFrame:
    """Score-weighted centre of the positive cells within ``reach`` of each peak."""
    around = F.array(
        *[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    )
    asked = peaks.select(*CELL_KEYS, "peak_idx", F.col("v").alias("score"), F.col("cy").alias("_py"), F.col("cx").alias("_px"), F.inline(around)).select(
        *CELL_KEYS, "peak_idx", "score", (F.col("_py") + F.col("dy")).alias("cy"), (F.col("_px") + F.col("dx")).alias("cx")
    )
    positive = grid.where("v > 0")
    return asked.join(positive, [*CELL_KEYS, "cy", "cx"]).groupBy(*CELL_KEYS, "peak_idx", "score").agg(
        (F.sum(F.col("cx") * F.col("v")) / F.sum("v") + offset[0]).alias("x"),
        (F.sum(F.col("cy") * F.col("v")) / F.sum("v") + offset[1]).alias("y"),
    )


def part_argmax(grid: DataFrame) -> DataFrame:
    """The best cell per part, the earlier one in raster order on ties."""
    return grid.groupBy(*CELL_KEYS).agg(
        F.max_by(F.struct("cy", "cx"), F.struct("v", -F.col("cy"), -F.col("cx"))).alias("_at"), F.max("v").alias("score")
    ).select(*CELL_KEYS, "_at.cy", "_at.cx", "score")


def merge_scales(grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average of aligned rasters over their scales."""
    return grids.groupBy(*keys, "cy", "cx").agg(F.avg("v").alias("v"))


def best_of_scales(estimates: DataFrame, keys: Sequence[str], scale: str) -> DataFrame:
    """The scale whose joints have the highest mean confidence, the first on ties."""
    means = estimates.groupBy(*keys, scale).agg(F.avg("c").alias("mean_c"))
    return means.groupBy(*keys).agg(
        F.max_by(scale, F.struct("mean_c", -F.col(scale))).alias("best_scale"), F.max("mean_c").alias("mean_c")
    )


def _pair_map(pairs: Sequence[tuple[int, int]]) -> Column:
    by_part: dict[int, list] = {}
    for i, (a, b) in enumerate(pairs):
        by_part.setdefault(a, []).append((i, b))
    return F.create_map(
        *[
            v
            for a, ps in by_part.items()
            for v in (F.lit(a), F.array(*[F.struct(F.lit(i).alias("pair_idx"), F.lit(b).alias("part_b")) for i, b in ps]))
        ]
    )


def candidate_pairs(candidates: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """The two ends of every possible limb of a frame (equi-join on frame and part).

    Parts hold at most the peak limit of candidates, so a frame's pairs are bounded by it.
    """
    a = candidates.select(
        *FRAME, F.col("cand_idx").alias("cand_a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("score").alias("a_score"),
        F.inline(F.try_element_at(_pair_map(pairs), F.col("part"))),
    )
    b = candidates.select(
        *FRAME, F.col("part").alias("part_b"), F.col("cand_idx").alias("cand_b"), F.col("x").alias("bx"), F.col("y").alias("by"),
        F.col("score").alias("b_score"),
    )
    return a.join(b, [*FRAME, "part_b"]).drop("part_b")


def limb_scores(
    ends: DataFrame, field: DataFrame, width: int, height: int, threshold: float, min_share: float, default: float
) -> DataFrame:
    """Mean alignment of the field along each candidate limb.

    ``field`` is (session_id, frame_idx, pair_idx, cy, cx, fx, fy).  The samples of a limb look their cells up
    by an equi-join and are summed again per limb; cells that the field lacks count as no alignment, so every limb has
    a score, also one whose ends coincide (0).
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    limb = ends.withColumn("_len", F.sqrt(dx * dx + dy * dy)).withColumn(
        "_n", clamp(half_up(F.sqrt(5.0 * F.greatest(F.abs(dx), F.abs(dy)))), 5, 25).cast("int")
    )
    keys = [*FRAME, "pair_idx", "cand_a", "cand_b", "a_score", "b_score", "_len", "_n"]
    sampled = limb.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        *keys,
        clamp(half_up(F.col("ax") + F.col("_k") * (dx / F.col("_n"))), 0, width - 1).cast("int").alias("cx"),
        clamp(half_up(F.col("ay") + F.col("_k") * (dy / F.col("_n"))), 0, height - 1).cast("int").alias("cy"),
        F.try_divide(dx, F.col("_len")).alias("_ux"),
        F.try_divide(dy, F.col("_len")).alias("_uy"),
    )
    dot = F.col("_ux") * F.col("fx") + F.col("_uy") * F.col("fy")
    good = F.when(dot > threshold, dot)
    summed = sampled.join(field, [*FRAME, "pair_idx", "cy", "cx"], "left").groupBy(*keys).agg(
        F.sum(good).alias("_sum"), F.count(good).alias("_good")
    )
    close = (height * width) ** 0.5 / 150
    score = (
        F.when(F.col("_len") <= 1e-6, F.lit(0.0))
        .when(F.col("_good") / F.col("_n") > min_share, F.col("_sum") / F.col("_good"))
        .when(F.col("_len") < close, F.lit(default + 1e-6))
        .otherwise(F.lit(0.0))
    )
    return summed.select(*FRAME, "pair_idx", "cand_a", "cand_b", "a_score", "b_score", score.alias("score"))


def limb_match_greedy(scores: DataFrame) -> DataFrame:
    """Best limbs first, each candidate used once per limb type; larger indexes win ties.

    One bounded list per (frame, limb type) is folded inside the row by ``aggregate``.
    """
    keys = [*FRAME, "pair_idx"]
    listed = scores.where("score > 1e-6").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("score", "cand_a", "cand_b")), asc=False).alias("_c")
    )
    empty = F.expr("cast(array() as array<struct<score:double,cand_a:int,cand_b:int>>)")

    def accept(kept, c):
        taken = F.exists(kept, lambda k: (k["cand_a"] == c["cand_a"]) | (k["cand_b"] == c["cand_b"]))
        return F.when(taken, kept).otherwise(F.array_append(kept, c))

    return listed.select(*keys, F.inline(F.aggregate("_c", empty, accept)))


def limb_rank_global(scores: DataFrame) -> DataFrame:
    """All limbs of a frame by total score, best first."""
    total = F.col("score") + 0.1 * F.col("a_score") + 0.1 * F.col("b_score")
    w = W.partitionBy(*FRAME).orderBy(*[F.desc(c) for c in ("total", "score", "pair_idx", "cand_a", "cand_b")])
    return (
        scores.where("score > 1e-6")
        .withColumn("total", total)
        .withColumn("rank", F.row_number().over(w))
    )


def assemble_people(limbs: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Greedy assembly of people from the ranked limbs of a frame.

    Spark gathers and orders one frame's limbs (bounded by the candidate limit) into a row; the
    order-dependent merge runs over Arrow batches of frames.  Returns one row per person part.
    """
    frames = limbs.where("score > 1e-6").groupBy(*FRAME).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (F.col("score") + 0.1 * F.col("a_score") + 0.1 * F.col("b_score")).alias("total"),
                    "score", "pair_idx", "cand_a", "cand_b", "a_score", "b_score",
                )
            ),
            asc=False,
        ).alias("limbs")
    )
    ends = list(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for session, frame, frame_limbs in zip(batch["session_id"], batch["frame_idx"], batch["limbs"]):
                for person, (parts, score) in enumerate(_merge_limbs(frame_limbs, ends)):
                    rows += [(session, frame, person, part, cand, float(score), len(parts)) for part, cand in sorted(parts.items())]
            yield pd.DataFrame(rows, columns=[*FRAME, "person_idx", "part", "cand_idx", "score", "n_parts"])

    return frames.mapInPandas(
        run, "session_id bigint, frame_idx bigint, person_idx int, part int, cand_idx int, score double, n_parts int"
    )


def _merge_limbs(limbs, ends):
    """People of one frame as ({part: candidate}, score), from limbs in rank order."""
    people: list[tuple[dict, float] | None] = []
    owner: dict[tuple[int, int], int] = {}
    for limb in limbs:
        part_a, part_b = ends[limb["pair_idx"]]
        a, b = (part_a, limb["cand_a"]), (part_b, limb["cand_b"])
        pa, pb = owner.get(a), owner.get(b)
        if pa is None and pb is None:
            owner[a] = owner[b] = len(people)
            people.append(({a[0]: a[1], b[0]: b[1]}, limb["a_score"] + limb["b_score"] + limb["score"]))
        elif pa is None or pb is None:
            mine, new, gain = (pb, a, limb["a_score"]) if pa is None else (pa, b, limb["b_score"])
            parts, score = people[mine]
            if new[0] not in parts:
                people[mine] = ({**parts, new[0]: new[1]}, score + gain + limb["score"])
                owner[new] = mine
        elif pa == pb:
            parts, score = people[pa]
            people[pa] = (parts, score + limb["score"])
        else:
            keep, drop = min(pa, pb), max(pa, pb)
            (kp, ks), (dp, ds) = people[keep], people[drop]
            if not kp.keys() & dp.keys():
                people[keep] = ({**dp, **kp}, ks + ds + limb["score"])
                people[drop] = None
                for node, who in owner.items():
                    if who == drop:
                        owner[node] = keep
    return [p for p in people if p is not None]


# Foot parts of the 25-part skeleton and the default thresholds.
FEET = (19, 25)
MIN_PARTS, MIN_SCORE = 3, 0.4


def filter_people(
    parts: DataFrame, keys: Sequence[str], min_parts: int = MIN_PARTS, min_score: float = MIN_SCORE, maximize: bool = False
) -> DataFrame:
    """People with enough parts and score per part; ``parts`` has one row per person part.

    Feet do not count, and a person with feet but at most four other parts goes, unless that
    leaves the frame empty: then feet count.  Both readings come from one pass.
    """
    frame = list(keys[:-1])
    p = parts.groupBy(*keys).agg(
        F.count("*").alias("n_all"),
        F.count_if(F.col("part").between(FEET[0], FEET[1] - 1)).alias("n_feet"),
        F.max("score").alias("score"),
    )
    n = F.col("n_all") - F.col("n_feet")
    lenient = (F.col("n_all") >= min_parts) & (F.col("score") / F.col("n_all") >= min_score)
    only_feet = (F.col("n_feet") > 0) & (n <= 4)
    strict = ~only_feet & (n >= min_parts) & F.coalesce(F.try_divide("score", n) >= min_score, F.lit(False))
    if maximize:
        return p.where(lenient)
    judged = p.withColumns({"_strict": strict, "_lenient": lenient})
    alive = judged.groupBy(*frame).agg(F.max("_strict").alias("_any"))
    return (
        judged.join(alive, frame)
        .where(F.col("_strict") | (~F.col("_any") & F.col("_lenient")))
        .drop("_strict", "_lenient", "_any")
    )


def people_to_keypoints(
    parts: DataFrame, peaks: DataFrame, keys: Sequence[str], n_parts: int, n_pairs: int, scale: float
) -> DataFrame:
    """Every part slot of every person: scaled coordinates, zero where absent, normalised score."""
    people = parts.groupBy(*keys).agg((F.max("score") / float(n_parts + n_pairs)).alias("person_score"))
    slots = people.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    frame = list(keys[:-1])
    placed = parts.join(peaks, [*frame, "part", "cand_idx"]).select(
        *keys, "part", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"), "c"
    )
    zero = F.lit(0.0)
    return slots.join(placed, [*keys, "part"], "left").withColumns({n: F.coalesce(n, zero) for n in ("x", "y", "c")})


def merge_stray_faces(faces: DataFrame, keep_iou: float = 0.3, few_iou: float = 0.01) -> DataFrame:
    """Attach faces without a body to the overlapping face of a person.

    ``faces`` is one row per face: session_id, frame_idx, person_idx, stray, box_x, box_y, box_w, box_h.
    Returns (session_id, frame_idx, stray person, person, iou) for the strays that merge.
    """
    from .people import overlapping_pairs

    real = faces.where("box_w > 0 AND box_h > 0")
    n_valid = faces.groupBy(*FRAME).agg(F.count_if(~F.col("stray")).alias("_valid"))
    pairs = overlapping_pairs(
        real.where("stray"), real.where("NOT stray"), list(FRAME), ["person_idx"], ["person_idx"]
    )
    area = lambda t: (F.col(f"x1_{t}") - F.col(f"x0_{t}")) * (F.col(f"y1_{t}") - F.col(f"y0_{t}"))
    inter = F.col("_iw") * F.col("_ih")
    best = pairs.withColumn("iou", F.try_divide(inter, area("a") + area("b") - inter)).groupBy(
        *FRAME, F.col("person_idx_a").alias("stray_person")
    ).agg(F.max_by("person_idx_b", F.struct("iou", -F.col("person_idx_b"))).alias("person_idx"), F.max("iou").alias("iou"))
    return best.join(n_valid, list(FRAME)).where(
        (F.col("iou") > keep_iou) | ((F.col("iou") > few_iou) & (F.col("_valid") < 3))
    ).drop("_valid")


def scale_grid(grid: DataFrame, mode: str, kind: str) -> DataFrame:
    """Clamp and map raster values: ``mode`` signed / unit / byte for part, background or field rasters."""
    v = F.col("v")
    if kind == "field":
        x = clamp(v, -1.0, 1.0)
        mapped = {"signed": x, "unit": 0.5 * (x + 1.0), "byte": half_up(128.5 * x + 128.5).cast("double")}
    else:
        x = clamp(v, 0.0, 1.0)
        mapped = {"signed": 2.0 * x - 1.0, "unit": x, "byte": half_up(255.0 * x).cast("double")}
    return grid.withColumn("v", mapped[mode])


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """Per frame and part the candidates as a list, best score first, then by index."""
    entry = F.struct((-F.col("score")).alias("_s"), "cand_idx", "x", "y", "score")
    ordered = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda e: F.struct(e["cand_idx"].alias("cand_idx"), e["x"].alias("x"), e["y"].alias("y"), e["score"].alias("score")),
    )
    return candidates.groupBy(*CELL_KEYS).agg(ordered.alias("candidates"))

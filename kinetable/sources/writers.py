"""Sinks: frame JSON, results, reports and detections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, functions as F

from ..functions.strings import last_number

FRAME = ("session_id", "frame_idx")

# Export order of the joints by variant, for the 25-part skeleton.
EXPORT_ORDER = {
    "body": (0, 16, 15, 18, 17, 5, 2, 6, 3, 7, 4, 12, 9, 13, 10, 14, 11),
    "foot": (19, 20, 21, 22, 23, 24),
}

# First parts of the hands and of the face, and the wrists, in the skeleton with 135 parts.
HANDS_135, FACE_135, LEFT_WRIST, RIGHT_WRIST = 25, 65, 9, 10

#: The same for the skeleton with 135 parts.
EXPORT_135 = {
    "body": tuple(range(17)),
    "foot": tuple(range(19, 25)),
    "face": tuple(range(FACE_135, FACE_135 + 68)),
    "hand21": (RIGHT_WRIST, *range(HANDS_135 + 20, HANDS_135 + 40)),
    "hand42": (LEFT_WRIST, *range(HANDS_135, HANDS_135 + 20), RIGHT_WRIST, *range(HANDS_135 + 20, HANDS_135 + 40)),
}

#: Joints that are gathered at a time.
BLOCK = 8


def image_id(variant: str, name: Column, frame: Column) -> Column:
    """Body and foot records are named by the image file's last number, the others by the frame's."""
    return last_number(name) if variant in ("body", "foot") else frame


def _flat(kps: Column, parts: int) -> Column:
    """x, y, c of every part in order, zeros where the person lacks it."""
    zero = F.lit(0.0)
    one = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda j: F.array(*[F.coalesce(F.try_element_at(kps, j)[n], zero) for n in ("x", "y", "c")]),
    )
    return F.flatten(one)


def person_maps(people: DataFrame, joints: Sequence[int] | None = None) -> DataFrame:
    """One row per person with its joints, or those of them that are named, as a map (bounded by the skeleton).

    The score is the mean over all joints.
    """
    if joints is not None:
        named = sorted(set(joints))
        entries = F.filter(F.arrays_zip(F.array(*[F.lit(j) for j in named]).alias("joint"), F.col("points").alias("at")), lambda e: e["at"].isNotNull())
        return person_points(people, named).select(*FRAME, "person_idx", F.map_from_entries(entries).alias("kps"), "score")
    joint = F.struct("joint", F.struct("x", "y", "c"))
    return people.groupBy(*FRAME, "person_idx").agg(F.map_from_entries(F.collect_list(joint)).alias("kps"), F.avg("c").alias("score"))


def person_points(people: DataFrame, joints: Sequence[int]) -> DataFrame:
    """One row per person with the named joints in their order as ``points``, NULL where it lacks one; those with a score above 0 are
    counted in ``shown``, and ``score`` is the mean over all joints.

    People are gathered by hashing: in blocks of a few joints, then whole, every value has a place of its own among running
    maxima; lists of joints would be sorted, and spilled, row by row.  A named joint that a person has twice is an error.
    """
    place = {j: k for k, j in enumerate(sorted(set(joints)))}
    known = F.array(*[F.lit(place.get(j)).cast("int") for j in range(max(joints) + 1)])
    at, blocks, axes = F.col("_at"), range(-(-len(place) // BLOCK)), ("x", "y", "c")
    cut = people.withColumn("_place", F.get(known, F.col("joint").cast("int"))).withColumns(
        {"_block": F.floor(F.col("_place") / F.lit(BLOCK)).cast("int"), "_at": F.col("_place") % BLOCK}
    )
    some = cut.groupBy(*FRAME, "person_idx", "_block").agg(
        F.sum("c").alias("_sum"), F.count("c").alias("_n"), F.count("_at").alias("_rows"), F.bit_or(F.expr("shiftleft(1, _at)")).alias("_found"),
        *[F.max(F.when(at == k, F.col(n))).alias(f"_{n}{k}") for k in range(BLOCK) for n in axes],
    )
    of = lambda b, c: F.max(F.when(F.col("_block") == b, F.col(c)))
    wide = some.groupBy(*FRAME, "person_idx").agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("score"), F.bool_or(F.col("_rows") > F.bit_count("_found")).alias("_twice"),
        *[of(b, "_found").alias(f"_found{b}") for b in blocks],
        *[of(k // BLOCK, f"_{n}{k % BLOCK}").alias(f"_{n}_{k}") for k in place.values() for n in axes],
    )

    def point(k):
        found = F.getbit(f"_found{k // BLOCK}", F.lit(k % BLOCK)) == 1
        return F.when(found, F.struct(*[F.col(f"_{n}_{k}").alias(n) for n in axes]))

    shown = F.size(F.filter(F.array(*[F.col(f"_c_{place[j]}") for j in joints]), lambda c: c > 0))
    once = F.when(F.col("_twice"), F.raise_error(F.lit("a joint of a person is repeated")).cast("int")).otherwise(shown)
    return wide.select(*FRAME, "person_idx", F.array(*[point(place[j]) for j in joints]).alias("points"), once.alias("shown"), "score")


def people_json(people: DataFrame, parts: int = 25, candidates: DataFrame | None = None, every: DataFrame | None = None) -> DataFrame:
    """Rows (session_id, name, value): the frame's JSON text, optionally with its part candidates.

    ``every`` lists all frames (session_id, frame_idx); those without people get an empty list.
    """
    flat = person_maps(people).select(*FRAME, "person_idx", _flat(F.col("kps"), parts).alias("pose_keypoints_2d"))
    frames = flat.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("person_idx", "pose_keypoints_2d"))).alias("_p"))
    if every is not None:
        frames = every.select(*FRAME).join(frames, list(FRAME), "left")
    people_of = F.coalesce("_p", F.array().cast(frames.schema["_p"].dataType))
    body = F.transform(people_of, lambda p: F.struct(p["pose_keypoints_2d"].alias("pose_keypoints_2d")))
    fields = [F.lit(1.3).alias("version"), F.col("name"), body.alias("people")]
    if candidates is not None:
        triple = F.transform(F.col("candidates"), lambda e: F.array(e["x"], e["y"], e["score"]))
        per_frame = candidates.select("session_id", "frame_idx", "part", F.flatten(triple).alias("_v")).groupBy(*FRAME).agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("part").cast("string"), "_v")))).alias("_c")
        )
        frames = frames.join(per_frame, list(FRAME), "left")
        fields.append(F.array("_c").alias("part_candidates"))
    name = F.concat(F.col("session_id").cast("string"), F.lit("_"), F.lpad(F.col("frame_idx").cast("string"), 12, "0"))
    return frames.withColumn("name", name).select("session_id", "name", F.to_json(F.struct(*fields)).alias("value"))


def foldered(rows: DataFrame, by: Sequence[str]) -> DataFrameWriter:
    """A folder per key, with as few files as its size allows: rows come together by key, and only a large key is cut.

    Tasks move their files into place themselves; the driver would do it one by one.
    """
    return rows.hint("rebalance", *by).write.partitionBy(*by).option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def write_people_json(frames: DataFrame, path: str) -> None:
    """One folder per session, many frames per file."""
    foldered(frames.select("session_id", "value"), ["session_id"]).text(path)


def coco_results(people: DataFrame, image_id: Column, variant: str = "body", orders: Mapping[str, Sequence[int]] = EXPORT_ORDER) -> DataFrame:
    """One record per person: re-ordered joints as (x, y, 1), unseen ones (-1, -1, 0); people
    without any joint of the variant are left out.  ``orders`` are those of the skeleton."""
    shown = lambda p: F.coalesce(p["c"] > 0, F.lit(False))
    triple = F.transform(
        "points",
        lambda p: F.when(shown(p), F.array(p["x"], p["y"], F.lit(1.0))).otherwise(F.array(F.lit(-1.0), F.lit(-1.0), F.lit(0.0))),
    )
    return (
        person_points(people, orders[variant]).where("shown > 0")
        .select(*FRAME, "person_idx", image_id.alias("image_id"), F.lit(1).alias("category_id"), F.flatten(triple).alias("keypoints"), "score")
    )


def write_json(rows: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines; readers unpack ``compression`` (gzip and others) by the ending of the files."""
    rows.write.option("compression", compression).json(path)


def write_summary_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def report(overall: DataFrame, group: str, config: dict[str, float] | None = None, first_errors: DataFrame | None = None) -> DataFrame:
    """One nested record: config, the overall row of grouped metrics, a map by group, and the first errors (a ranked, bounded table)."""
    values = F.struct(*[c for c in overall.columns if c != group])
    rows = overall.select(F.col(group).alias("_group"), values.alias("_values"))
    fields = [
        F.max(F.when(F.col("_group") == "overall", F.col("_values"))).alias("overall"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("_group") != "overall", F.struct("_group", "_values"))))).alias("by_category"),
    ]
    if first_errors is not None:
        rows = rows.unionByName(first_errors.select(F.struct(*first_errors.columns).alias("_error")), allowMissingColumns=True)
        fields.append(F.sort_array(F.collect_list("_error")).alias("first_errors"))
    out = rows.agg(*fields)
    return out.withColumn("config", F.struct(*[F.lit(v).alias(k) for k, v in config.items()])) if config else out


def write_detections(rows: DataFrame, path: str, by: Sequence[str] = ("session_id",)) -> None:
    """Per-session folders; existing output is never overwritten."""
    foldered(rows, by).mode("errorifexists").parquet(path)

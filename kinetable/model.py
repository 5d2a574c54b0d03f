"""Schemas and the small skeleton dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

KEYPOINTS = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("joint", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("c", T.DoubleType()),
    ]
)

# Part names by skeleton, in index order.
PART_NAMES = {
    "parts25": [
        "Nose", "Neck", "RShoulder", "RElbow", "RWrist", "LShoulder", "LElbow", "LWrist", "MidHip", "RHip", "RKnee",
        "RAnkle", "LHip", "LKnee", "LAnkle", "REye", "LEye", "REar", "LEar", "LBigToe", "LSmallToe", "LHeel",
        "RBigToe", "RSmallToe", "RHeel",
    ],
    "parts18": [
        "Nose", "Neck", "RShoulder", "RElbow", "RWrist", "LShoulder", "LElbow", "LWrist", "RHip", "RKnee", "RAnkle",
        "LHip", "LKnee", "LAnkle", "REye", "LEye", "REar", "LEar",
    ],
    "parts15": [
        "Head", "Neck", "RShoulder", "RElbow", "RWrist", "LShoulder", "LElbow", "LWrist", "RHip", "RKnee", "RAnkle",
        "LHip", "LKnee", "LAnkle", "Chest",
    ],
}

# Limb pairs by skeleton, in index order.
PART_PAIRS = {
    "parts25": (
        (1, 8), (1, 2), (1, 5), (2, 3), (3, 4), (5, 6), (6, 7), (8, 9), (9, 10), (10, 11), (8, 12), (12, 13),
        (13, 14), (1, 0), (0, 15), (15, 17), (0, 16), (16, 18), (2, 17), (5, 18), (14, 19), (19, 20), (14, 21),
        (11, 22), (22, 23), (11, 24),
    ),
    "parts18": (
        (1, 2), (1, 5), (2, 3), (3, 4), (5, 6), (6, 7), (1, 8), (8, 9), (9, 10), (1, 11), (11, 12), (12, 13),
        (1, 0), (0, 14), (14, 16), (0, 15), (15, 17), (2, 16), (5, 17),
    ),
}


def skeleton_parts(spark: SparkSession) -> DataFrame:
    rows = [(m, i, n) for m, names in PART_NAMES.items() for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "model string, part int, name string")


def skeleton_pairs(spark: SparkSession) -> DataFrame:
    rows = [(m, i, a, b) for m, pairs in PART_PAIRS.items() for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "model string, pair_idx int, part_a int, part_b int")


def part_index(model: str, *names: str) -> int:
    """Index of the first of ``names`` the skeleton has."""
    known = {n: i for i, n in enumerate(PART_NAMES[model])}
    for n in names:
        if n in known:
            return known[n]
    raise KeyError(f"none of {names} in {model}")

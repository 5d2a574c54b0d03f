"""Splits, manifests, set operations and pivots of datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import literal_map
from ..functions.strings import stable_hash
from .chunks import dense_index


def stratified_split(
    rows: DataFrame, key: str, strata: Sequence[str], salt: str, train: float = 0.70, validation: float = 0.15
) -> DataFrame:
    """Deterministic split per stratum by hash order.

    A stratum can be a large share of the table, so its rows are ranked inside the 4096 ranges of
    their hash prefix and shifted by the counts before: the hash spreads them evenly.
    """
    if not 0 < train < 1 or not 0 < validation < 1 - train:
        raise ValueError("fractions must leave room for every split")
    hashed = rows.withColumn("_hash", stable_hash(salt, F.col(key)))
    ranked = dense_index(hashed, strata, ["_hash", key], F.left("_hash", F.lit(3)), "_rank")
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    first = F.bround(F.col("_n") * train)
    second = first + F.bround(F.col("_n") * validation)
    return (
        ranked.join(sizes, list(strata))
        .withColumn(
            "split",
            F.when(F.col("_rank") < first, "train").when(F.col("_rank") < second, "validation").otherwise("test"),
        )
        .drop("_hash", "_rank", "_n")
    )


def subject_split(rows: DataFrame, subject: str, splits: dict[int, str]) -> DataFrame:
    """Fixed subject -> split; an unmapped subject becomes an error text instead of a split."""
    split = literal_map(splits)[F.col(subject)]
    return rows.withColumn("split", split).withColumn(
        "error", F.when(split.isNull(), F.concat(F.lit("no split for subject "), F.col(subject).cast("string")))
    )


def append_train(main: DataFrame, extra: DataFrame) -> DataFrame:
    """Only the extra training rows join; the other splits stay as they are."""
    return main.unionByName(extra.where("split = 'train'"), allowMissingColumns=True)


def enrich_descriptions(manifest: DataFrame, descriptions: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    out = manifest.join(descriptions.select(on, *columns), on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def missing_artifacts(manifest: DataFrame, artifacts: DataFrame, on: str) -> DataFrame:
    return manifest.join(artifacts, on, "left_anti")


def pending_work(manifest: DataFrame, finished: DataFrame, on: str) -> DataFrame:
    return manifest.join(finished, on, "left_anti")


def dataset_scope(outputs: DataFrame, dataset: DataFrame, on: str) -> DataFrame:
    return outputs.join(dataset, on, "left_semi")


def reconcile_counts(declared: DataFrame, frames: DataFrame) -> DataFrame:
    """Sessions whose declared frame count differs from the frames found."""
    found = frames.groupBy("session_id").agg(F.count("*").alias("found_frames"))
    return declared.join(found, "session_id", "left").where(
        F.col("declared_frames") != F.coalesce("found_frames", F.lit(0))
    )


def attach_cameras(views: DataFrame, cameras: DataFrame) -> DataFrame:
    """Camera parameters onto frame views.  A rig has few cameras; the engine's size check decides
    whether the side is broadcast."""
    return views.join(cameras, "camera_id")


def duplicate_variants(responses: DataFrame, question: str, variant: str) -> DataFrame:
    return responses.groupBy(question, variant).agg(F.count("*").alias("n")).where("n > 1")


def pivot_variants(responses: DataFrame, question: str, variant: str, text: str, variants: Sequence[str]) -> DataFrame:
    """One row per question, one column per variant label; of several answers the smallest text (see ``duplicate_variants``)."""
    if len(set(variants)) != len(variants):
        raise ValueError("duplicate variant labels")
    return responses.groupBy(question).pivot(variant, list(variants)).agg(F.min(text))


def order_frames(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Total order by range partitioning; no single-task sort."""
    return rows.orderBy(*keys)


def apply_steps(df: DataFrame, *steps) -> DataFrame:
    """User pre/post-processing functions, DataFrame to DataFrame, in order."""
    for step in steps:
        df = df.transform(step)
    return df


def with_score(df: DataFrame, scorer, inputs: Sequence[str], name: str) -> DataFrame:
    """Probability column from a caller-supplied vectorised UDF."""
    return df.withColumn(name, scorer(*[F.col(c) for c in inputs]))

"""Multi-view assembly, validity, triangulation and reprojection errors.

Observations are (session_id, frame_idx, joint, camera_id, x, y, c); cameras carry a 3x4 matrix as
``p`` (12 doubles, row-major) and an image size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .quantiles import trimmed_mean_limit

POINT = ("session_id", "frame_idx", "joint")


def assemble_views(views: DataFrame, keys: Sequence[str], view: str, total: str) -> DataFrame:
    """Frames whose views have all arrived, with the views in order."""
    return (
        views.groupBy(*keys, total)
        .agg(F.sort_array(F.collect_set(view)).alias("views"))
        .where(F.size("views") == F.col(total))
    )


def valid_view_keypoints(obs: DataFrame, cameras: DataFrame, score: float = 0.35, border: float = 8.0) -> DataFrame:
    """Observations that are confident and away from the image border, with the camera attached.

    The few cameras are broadcast: of their size nothing may be known, and the observations must not be taken instead.
    """
    inside = (
        (F.col("c") > score) & (F.col("x") > border) & (F.col("x") < F.col("width") - border)
        & (F.col("y") > border) & (F.col("y") < F.col("height") - border)
    )
    return obs.join(F.broadcast(cameras), "camera_id").where(inside)


def default_min_views(n_cameras: int) -> int:
    return max(2, min(4, n_cameras - 1))


def min_views(valid: DataFrame, n_cameras: int, minimum: int = 0) -> DataFrame:
    """Joints seen by enough views."""
    need = minimum if minimum > 0 else default_min_views(n_cameras)
    return valid.groupBy(*POINT).agg(F.count("*").alias("n_views")).where(F.col("n_views") >= need)


def projected(df: DataFrame, px: str = "px", py: str = "py", pz: str = "pz") -> tuple[Column, Column]:
    p, x, y, z = F.col("p"), F.col(px), F.col(py), F.col(pz)
    row = lambda r: p[4 * r] * x + p[4 * r + 1] * y + p[4 * r + 2] * z + p[4 * r + 3]
    return F.try_divide(row(0), row(2)), F.try_divide(row(1), row(2))


def with_reprojection_error(obs: DataFrame) -> DataFrame:
    """``error`` in pixels of observations that carry their 3-D point and camera matrix."""
    u, v = projected(obs)
    return obs.withColumn("error", F.sqrt(F.pow(u - F.col("x"), 2) + F.pow(v - F.col("y"), 2)))


def _view_lists(valid: DataFrame, minimum: int) -> DataFrame:
    """One row per point with its views (bounded by the number of cameras)."""
    view = F.struct("camera_id", "x", "y", "p")
    return valid.groupBy(*POINT).agg(F.sort_array(F.collect_list(view)).alias("views")).where(
        F.size("views") >= minimum
    )


def _null_points(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Null vectors of the stacked 2-rows-per-view systems as points: x, y (n, views), p (n, views, 12) to (n, 3)."""
    p = p.reshape(*x.shape, 3, 4)
    rows = np.concatenate([x[..., None] * p[:, :, 2] - p[:, :, 0], y[..., None] * p[:, :, 2] - p[:, :, 1]], axis=1)
    h = np.linalg.svd(rows)[2][:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return h[:, :3] / h[:, 3:]


def _flat(views: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Where each row's views begin, how many they are, and number of the camera (-1: none), x, y, p of all views."""
    lengths = pc.fill_null(pc.list_value_length(views), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    view = views.flatten()
    camera = pc.rank(view.field("camera_id"), tiebreaker="dense", null_placement="at_start").to_numpy(zero_copy_only=False).astype(np.int64) if len(view) else np.zeros(0, np.int64)
    camera = np.where(view.field("camera_id").is_valid().to_numpy(zero_copy_only=False), camera, -1)
    x, y = [view.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("x", "y")]
    p = view.field("p").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(view), 12)
    return np.cumsum(lengths) - lengths, lengths, camera, x, y, p


def _solve(views: pa.ListArray) -> np.ndarray:
    """Points of all rows, one batched SVD per view count."""
    begin, lengths, _, x, y, p = _flat(views)
    out = np.full((len(lengths), 3), np.nan)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        cell = begin[at, None] + np.arange(n)
        out[at] = _null_points(x[cell], y[cell], p[cell])
    return out


def _solve_without(views: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Points of all rows without the camera of one view, for every view in order; and how many each row has."""
    begin, lengths, camera, x, y, p = _flat(views)
    row = np.repeat(np.arange(len(lengths)), lengths)  # of each view that is left out
    out = np.full((len(row), 3), np.nan)
    for n in np.unique(lengths):
        left_out = np.flatnonzero(lengths[row] == n)
        cell = begin[row[left_out], None] + np.arange(n)
        stay = (camera[cell] != camera[left_out, None]) & (camera[cell] >= 0) & (camera[left_out, None] >= 0)
        for m in np.unique(stay.sum(1)):
            some = stay.sum(1) == m
            kept = cell[some][stay[some]].reshape(-1, m)
            out[left_out[some]] = _null_points(x[kept], y[kept], p[kept])
    return out, lengths


def _with_columns(points: DataFrame, run, **more: T.DataType) -> DataFrame:
    """``run`` gives these columns of an Arrow batch; the others go on as they are."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            yield pa.RecordBatch.from_arrays([*b.columns, *run(b)], names=[*b.schema.names, *more])

    return points.mapInArrow(batches, T.StructType([*points.schema.fields, *[T.StructField(n, t) for n, t in more.items()]]))


def solve_points(points: DataFrame) -> DataFrame:
    """px, py, pz of every row's ``views`` over Arrow batches; NULL where it is no number."""
    return _with_columns(points, lambda b: [pa.array(v, from_pandas=True) for v in _solve(b.column("views")).T], px=T.DoubleType(), py=T.DoubleType(), pz=T.DoubleType())


def _mean_error(views: Column, px: Column, py: Column, pz: Column) -> Column:
    """Mean reprojection error of a point over its views, as an array expression."""

    def err(v):
        p = v["p"]
        row = lambda r: p[4 * r] * px + p[4 * r + 1] * py + p[4 * r + 2] * pz + p[4 * r + 3]
        return F.sqrt(F.pow(F.try_divide(row(0), row(2)) - v["x"], 2) + F.pow(F.try_divide(row(1), row(2)) - v["y"], 2))

    return F.aggregate(views, F.lit(0.0), lambda acc, v: acc + err(v)) / F.size(views)


def with_mean_error(points: DataFrame) -> DataFrame:
    """Mean reprojection error over the row's views."""
    return points.withColumn("error", _mean_error(F.col("views"), F.col("px"), F.col("py"), F.col("pz")))


def triangulate(valid: DataFrame, minimum: int) -> DataFrame:
    """3-D point and mean reprojection error of every joint seen by ``minimum`` views."""
    return with_mean_error(solve_points(_view_lists(valid, minimum)))


def max_acceptable_error(width: int, height: int) -> float:
    return 25 * (width * height / 1310720.0) ** 0.5


def drop_worst_view(solved: DataFrame, limit: float) -> DataFrame:
    """Leave one view out where that cuts a large error below 0.9 of it.

    Only points with four or more views and an error over half the limit are solved again, in the row they come in; the
    others pass through.  ``solved`` has one row per point; points without a key pass through too.
    """
    suspect = (F.size("views") >= 4) & (F.col("error") > 0.5 * limit)
    for n in POINT:
        suspect = suspect & F.col(n).isNotNull()

    def tries(b: pa.RecordBatch) -> list[pa.Array]:
        again = b.column("_again")
        xyz, n = _solve_without(b.column("views").filter(again))
        ends = np.zeros(b.num_rows + 1, np.int64)
        ends[1:][again.to_numpy(zero_copy_only=False)] = n
        one = pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in xyz.T], ["px", "py", "pz"])
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), one)]

    point = T.StructType([T.StructField(n, T.DoubleType()) for n in ("px", "py", "pz")])
    tried = _with_columns(solved.select("*", F.coalesce(suspect, F.lit(False)).alias("_again")), tries, _tries=T.ArrayType(point))
    rest = lambda i: F.filter("views", lambda v: v["camera_id"] != F.get("views", i)["camera_id"])
    left = F.transform("_tries", lambda t, i: F.struct(_mean_error(rest(i), t["px"], t["py"], t["pz"]).alias("error"), i.alias("left_out"), *[t[n].alias(n) for n in ("px", "py", "pz")]))
    b = F.col("_b")
    best = tried.withColumn("_b", F.array_min(F.filter(left, lambda t: t["error"] < 0.9 * F.col("error"))))
    return best.select(
        *POINT,
        *[F.when(b.isNotNull(), b[n]).otherwise(F.col(n)).alias(n) for n in ("px", "py", "pz", "error")],
        F.when(b.isNotNull(), rest(b["left_out"])).otherwise(F.col("views")).alias("views"),
        b["left_out"].alias("dropped_view"),
    )


def reject_outlier_points(points: DataFrame, limit: float) -> DataFrame:
    """Keep finite points whose error is below 5x the frame's mean and below the limit."""
    mean = F.avg("error").over(W.partitionBy("session_id", "frame_idx"))
    ok = F.lit(True)
    for n in ("px", "py", "pz"):
        ok = ok & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return points.withColumn("_mean", mean).where(
        ok & (F.col("error") < 5 * F.col("_mean")) & (F.col("error") < limit)
    ).drop("_mean")


def iterative_outlier_removal(obs: DataFrame, floor: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Drop observations above max(2 x mean error, floor) until no more are dropped.

    Gives the observations left and, as one row, the limit at which it ends.  Nothing runs while the query is planned.
    """
    limit = trimmed_mean_limit(obs, "error", 2.0, floor)
    return obs.where(F.col("error") <= limit.scalar()), limit


def multi_view_mask(obs: DataFrame) -> DataFrame:
    """Flag observations of points that more than one camera sees."""
    n = F.count("*").over(W.partitionBy(*POINT))
    return obs.withColumn("usable", n > 1)

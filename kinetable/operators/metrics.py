"""Confusion metrics, searches over score grids and other evaluation aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(truth: str, pred: str) -> list[Column]:
    t, p = F.col(truth), F.col(pred)
    return [
        F.count("*").alias("samples"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the four counts; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumns({"precision": p, "recall": r}).withColumns(
        {
            "accuracy": _ratio(tp + F.col("tn"), F.col("samples")),
            "f1": _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        }
    )


def binary_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return with_rates(df.groupBy(*by).agg(*confusion(truth, pred)))


def metrics_by_group(df: DataFrame, truth: str, pred: str, group: str) -> DataFrame:
    """Overall and per group from one pass."""
    sets = df.groupingSets([[F.col(group)], []], F.col(group)).agg(
        *confusion(truth, pred), F.grouping(group).alias("_all")
    )
    named = sets.withColumn(group, F.when(F.col("_all") == 1, "overall").otherwise(F.col(group)))
    return with_rates(named.drop("_all"))


def first_n(df: DataFrame, order: Sequence[str | Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows with their rank.  ``orderBy.limit`` keeps n rows per task before one
    task ranks the survivors."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(name, F.row_number().over(W.orderBy(*order)))


def threshold_steps(start: float, step: float, count: int) -> list[float]:
    return [start + i * step for i in range(count)]


def score_grid(
    df: DataFrame, truth: str, weights: Sequence[tuple], scores: Sequence[str], thresholds: Sequence[float], by: Sequence[str]
) -> DataFrame:
    """Confusion counts for every (weights, threshold) cell, per ``by``.

    A row is blended once per weight vector and counted by how many thresholds it passes, so the
    exchange carries (weights x threshold) counters, not rows; the cells follow by summing the
    counters from the top.
    """
    vectors = F.array(
        *[F.struct(F.lit(i).alias("weight_id"), *[F.lit(float(x)).alias(f"w_{s}") for s, x in zip(scores, w)])
          for i, w in enumerate(weights)]
    )
    fanned = df.select(*by, truth, *scores, F.inline(vectors))
    blend = sum((F.col(f"w_{s}") * F.col(s) for s in scores[1:]), F.col(f"w_{scores[0]}") * F.col(scores[0]))
    fanned = fanned.withColumn("_p", blend)
    passed = sum(((F.col("_p") >= t).cast("int") for t in thresholds[1:]), (F.col("_p") >= thresholds[0]).cast("int"))
    keys = [*by, "weight_id", *[f"w_{s}" for s in scores]]
    counted = fanned.groupBy(*keys, passed.alias("_passed")).agg(
        F.count_if(F.col(truth) == 1).alias("_pos"), F.count_if(F.col(truth) == 0).alias("_neg")
    )
    cells = F.array(
        *[F.struct(F.lit(i).alias("threshold_id"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)]
    )
    opened = counted.select(*keys, "_passed", "_pos", "_neg", F.inline(cells))
    above = F.col("_passed") > F.col("threshold_id")
    out = opened.groupBy(*keys, "threshold_id", "threshold").agg(
        F.sum(F.col("_pos") + F.col("_neg")).alias("samples"),
        F.sum(F.when(above, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, 0).otherwise(F.col("_neg"))).alias("tn"),
        F.sum(F.when(above, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("_pos"))).alias("fn"),
    )
    return with_rates(out)


def best_cell(grid: DataFrame, rank: Sequence[Column], split: str, choose_on: str, report_on: str) -> DataFrame:
    """The cell ranked best on one split, with its metrics on that split and on the report split."""
    order = [*[F.desc(r) if isinstance(r, str) else r.desc() for r in rank], F.asc("weight_id"), F.asc("threshold_id")]
    names = ["samples", "tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "f1"]
    top = grid.where(F.col(split) == choose_on).orderBy(*order).limit(1)
    top = top.drop(split).withColumnsRenamed({n: f"{choose_on}_{n}" for n in names})
    other = grid.where(F.col(split) == report_on).select(
        "weight_id", "threshold_id", *[F.col(n).alias(f"{report_on}_{n}") for n in names]
    )
    return top.join(other, ["weight_id", "threshold_id"])


def cross_entropy(df: DataFrame, logits: Sequence[str], truth: str) -> DataFrame:
    """Mean softmax loss and number of correct argmax predictions."""
    peak = F.greatest(*logits)
    total = sum((F.exp(F.col(c) - peak) for c in logits[1:]), F.exp(F.col(logits[0]) - peak))
    arr = F.array(*logits)
    own = F.element_at(arr, F.col(truth) + 1)
    guess = F.array_position(arr, peak) - 1
    return df.agg(
        F.avg(F.log(total) + peak - own).alias("mean_loss"),
        F.count("*").alias("samples"),
        F.count_if(guess == F.col(truth)).alias("correct"),
    )


def topk_accuracy(
    df: DataFrame, logits: Sequence[str], truth: str, ks: Sequence[int], ignore: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Share of rows where fewer than k other classes score at least the true class."""
    own = F.element_at(F.array(*logits), F.col(truth) + 1)
    better = sum(((F.col(c) >= own).cast("int") for c in logits[1:]), (F.col(logits[0]) >= own).cast("int")) - 1
    kept = df if ignore is None else df.where(F.col(truth) != ignore)
    return kept.withColumn("_better", better).groupBy(*by).agg(
        F.count("*").alias("samples"),
        *[F.avg((F.col("_better") < k).cast("double")).alias(f"top{k}") for k in ks],
    )


def joint_quality(keypoints: DataFrame, threshold: float = 0.3) -> DataFrame:
    return keypoints.groupBy("session_id", "joint").agg(
        F.avg("c").alias("mean_confidence"),
        F.avg((F.col("c") >= threshold).cast("double")).alias("valid_ratio"),
    )


def session_quality(keypoints: DataFrame) -> DataFrame:
    """Frames, detected and missing frames and the detected share of each session."""
    seen = keypoints.groupBy("session_id", "frame_idx").agg(F.max(F.col("c") > 0).alias("_seen"))
    return seen.groupBy("session_id").agg(
        F.count("*").alias("frames"),
        F.count_if("_seen").alias("detected"),
        F.count_if(~F.col("_seen")).alias("missing"),
        F.avg(F.col("_seen").cast("double")).alias("detected_ratio"),
    )


def split_counts(rows: DataFrame, domain: dict[str, Sequence[str]]) -> DataFrame:
    """Counts of every combination of the named column values, zero cells included.

    One zero-weight row per cell is appended before the aggregation: no join is needed.
    """
    names = list(domain)
    cells = rows.sparkSession.range(1)
    for n in names:
        cells = cells.withColumn(n, F.explode(F.array(*[F.lit(v) for v in domain[n]])))
    zero = cells.select(*names, F.lit(0).alias("_one"))
    return rows.select(*names, F.lit(1).alias("_one")).unionByName(zero).groupBy(*names).agg(F.sum("_one").alias("n"))


def circular_mean(df: DataFrame, key: str, angle: str) -> DataFrame:
    """Mean angle per key: in (-pi, pi], re-wrapped to [0, 2pi) when the spread reaches pi.

    Both wrappings are aggregated in the same pass and the right one is picked afterwards.
    """
    from ..functions.columns import PI, wrap_2pi, wrap_pi

    g = df.select(key, wrap_pi(F.col(angle)).alias("_a"), wrap_2pi(F.col(angle)).alias("_b")).groupBy(key).agg(
        (F.max("_a") - F.min("_a")).alias("_ra"),
        (F.max("_b") - F.min("_b")).alias("_rb"),
        F.avg("_a").alias("_ma"),
        F.avg("_b").alias("_mb"),
        F.count("*").alias("n"),
    )
    wide = F.col("_ra") >= PI
    return g.select(
        key,
        "n",
        wrap_pi(F.when(wide, F.col("_mb")).otherwise(F.col("_ma"))).alias("mean_angle"),
        (F.when(wide, F.col("_rb")).otherwise(F.col("_ra")) < PI).alias("consistent"),
    )


def reprojection_summary(obs: DataFrame) -> DataFrame:
    """Per camera and over all: RMS, mean and maximum error and the point of the maximum."""
    g = obs.rollup("camera_id").agg(
        F.sqrt(F.sum(F.col("error") * F.col("error")) / F.count("*")).alias("rms"),
        F.avg("error").alias("mean_error"),
        F.max("error").alias("max_error"),
        F.max_by(F.struct("camera_id", "point_id"), F.struct("error", -F.col("point_id"), -F.col("camera_id"))).alias("_at"),
        F.count("*").alias("n"),
    )
    return g.select(
        "camera_id", "n", "rms", "mean_error", "max_error",
        F.col("_at.point_id").alias("max_point"),
    )

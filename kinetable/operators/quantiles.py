"""Ranks of values that may repeat any number of times.

Equal values are counted before anything is exchanged, so what is ranked are distinct values with counts; a key with one
constant value is one row per task.  The distinct values of a key are cut into parts at approximate quantiles (a sketch that
tasks merge).  Totals of the parts say which part holds a rank, and only such parts are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PARTS = 64


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _n): the distinct known values of each key and how often they occur."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def in_parts(values: DataFrame, keys: Sequence[str], parts: int = PARTS) -> DataFrame:
    """Distinct values with ``_part``, which rises with the value; the parts of a key hold about as many of them each."""
    at = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = values.groupBy(*keys).agg(F.percentile_approx("_v", at).alias("_cuts"))
    return values.join(cuts, list(keys)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")


def before_parts(cut: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, _part) with the totals of ``sums`` (``_m_``), of the parts before (``_b_``) and of the key (``_a_``)."""
    keys = list(keys)
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_m_{n}") for n, c in sums.items()])
    return totals.select(
        *keys, "_part", *[F.col(f"_m_{n}") for n in sums],
        *[F.coalesce(F.sum(f"_m_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_m_{n}").over(W.partitionBy(*keys)).alias(f"_a_{n}") for n in sums],
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles by rank: keys, n and a column per point."""
    keys = list(keys)
    cut = in_parts(counted(df, keys, value), keys)
    parts = before_parts(cut, keys, {"n": F.col("_n")})
    asks = []
    for name, q in points.items():
        at = F.lit(float(q)) * (F.col("_a_n") - 1)
        share = at - F.floor(at)
        asks.append(F.struct(F.lit(name).alias("point"), F.floor(at).alias("rank"), (1.0 - share).alias("w")))
        asks.append(F.struct(F.lit(name).alias("point"), (F.floor(at) + 1).alias("rank"), share.alias("w")))
    here = lambda a: (a["w"] > 0) & (a["rank"] >= F.col("_b_n")) & (a["rank"] < F.col("_b_n") + F.col("_m_n"))
    wanted = parts.withColumn("_asks", F.filter(F.array(*asks), here)).where(F.size("_asks") > 0)
    w = W.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = cut.join(wanted, [*keys, "_part"]).withColumn("_to", F.col("_b_n") + F.sum("_n").over(w))
    mine = F.filter("_asks", lambda a: (a["rank"] < F.col("_to")) & (a["rank"] >= F.col("_to") - F.col("_n")))
    found = ranked.select(*keys, "_v", F.col("_a_n").alias("n"), F.inline(mine))
    return found.groupBy(*keys, "n").agg(*[F.sum(F.when(F.col("point") == p, F.col("w") * F.col("_v"))).alias(p) for p in points])


def trimmed_mean_limit(df: DataFrame, value: str, times: float, floor: float) -> DataFrame:
    """One row: ``limit``, where dropping all values above max(``times`` x mean of those left, ``floor``) comes to an end.

    The mean of the r smallest values rises with r, so the number that survives a round rises with the number before it, and
    the rounds, which start from all values, end at the largest r whose last value is within the limit of its own r values.
    That r is read off prefix sums over the ranked values; no round is played.
    """
    cut = in_parts(counted(df.select(F.lit(0).alias("_all"), value), ["_all"], value), ["_all"])
    sums = {"n": F.col("_n"), "s": F.col("_n") * F.col("_v")}
    w = W.partitionBy("_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = cut.join(before_parts(cut, ["_all"], sums), ["_all", "_part"])
    mean = (F.col("_b_s") + F.sum(sums["s"]).over(w)) / (F.col("_b_n") + F.sum("_n").over(w))
    ranked = ranked.select("_v", F.greatest(mean * F.lit(float(times)), F.lit(float(floor))).alias("_limit"))
    return ranked.where(F.col("_v") <= F.col("_limit")).agg(F.max_by("_limit", "_v").alias("limit"))

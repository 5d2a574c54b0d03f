"""Percentiles of repeated values and the end of trimming, against numpy and the loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import multiview, quantiles


@pytest.fixture(scope="module")
def values():
    rng = random.Random(6)
    out = [(1, 0.04)] * 500 + [(2, rng.gauss(0, 1e6)) for _ in range(700)] + [(3, float(rng.randrange(4))) for _ in range(300)]
    out += [(4, -1.5), (5, None), (None, 2.0), (None, 3.0)] + [(6, float(k)) for k in range(200)] + [(6, 7.0)] * 1000
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [64, 3])
def test_percentiles(spark, values, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    monkeypatch.setattr(quantiles.in_parts, "__defaults__", (parts,))
    df = spark.createDataFrame(values, "k long, v double").repartition(4).where("k IS NOT NULL")
    got = {r.k: r for r in quantiles.exact_percentiles(df, ["k"], "v", {"a": 0.0, "m": 0.5, "p": 0.95, "z": 1.0}).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    for k in got:
        own = [v for j, v in values if j == k]
        assert [got[k].n, *[got[k][c] for c in "ampz"]] == pytest.approx([len(own), *np.percentile(own, [0, 50, 95, 100])])


def test_equal_values_are_one_row_a_task(spark):
    df = spark.range(0, 10_000, 1, 4).select(F.lit(1).alias("k"), F.lit(0.1).alias("v"))
    assert [tuple(r) for r in quantiles.counted(df, ["k"], "v").collect()] == [(1, 0.1, 10_000)]


def trimmed(errors, floor):
    kept, limit = errors, None
    while kept:
        limit = max(2 * sum(kept) / len(kept), floor) if limit is None else min(limit, max(2 * sum(kept) / len(kept), floor))
        left = [e for e in kept if e <= limit]
        if len(left) == len(kept):
            return sorted(left), limit
        kept = left
    return [], None


@pytest.mark.parametrize("floor", [0.0, 1.0, 5.0, 1000.0])
@pytest.mark.parametrize("seed", range(3))
def test_trimming_ends_where_the_rounds_end(spark, floor, seed):
    rng = random.Random(seed)
    errors = [rng.expovariate(1) * 10 ** rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(400)] + [2.5] * 60
    errors = [round(e, 3) for e in errors]
    kept, limit = multiview.iterative_outlier_removal(spark.createDataFrame([(e,) for e in errors], "error double").repartition(3), floor)
    want, last = trimmed(errors, floor)
    assert sorted(r.error for r in kept.collect()) == want
    assert limit.first().limit == pytest.approx(last)


def test_nothing_to_trim(spark):
    none = spark.createDataFrame([], "error double")
    kept, limit = multiview.iterative_outlier_removal(none)
    assert kept.count() == 0 and limit.first().limit is None

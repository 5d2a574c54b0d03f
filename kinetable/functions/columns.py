"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def py_round(x: float) -> int:
    """Half-to-even rounding of window sizes; kept explicit because SQL ``round`` is half-up."""
    return int(round(x))


def frames(fps: float, seconds: float) -> int:
    return max(1, py_round(fps * seconds))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def finite(x: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def finite_max(*cols: Column) -> Column:
    """Largest finite value, 0 if there is none."""
    return F.coalesce(F.greatest(*[finite(c) for c in cols]), F.lit(0.0))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def wrap_2pi(x: Column) -> Column:
    """Angle in [0, 2*pi)."""
    return F.pmod(x, F.lit(TWO_PI))


def wrap_pi(x: Column) -> Column:
    """Angle in (-pi, pi]."""
    w = wrap_2pi(x)
    return F.when(w > PI, w - TWO_PI).otherwise(w)


PI = 3.141592653589793
TWO_PI = 6.283185307179586

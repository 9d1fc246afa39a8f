"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

INF = float("inf")


def to_numeric(value: Column) -> Column:
    """Double, with unreadable text, NaN and infinities as null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != INF), number)


def log_clip(value: Column) -> Column:
    """``log1p(max(x, 0))``; null stays null (``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0))))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Null instead of a division by zero."""
    return F.try_divide(top, F.nullif(bottom, F.lit(0.0)))


def date_of(day: Column) -> Column:
    """DATE from an integer ``YYYYMMDD``."""
    whole = day.cast("int")
    return F.make_date(
        F.floor(whole / 10000).cast("int"),
        (F.floor(whole / 100) % 100).cast("int"),
        (whole % 100).cast("int"),
    )


def day_number(day: Column) -> Column:
    """Days since 1970-01-01 of an integer ``YYYYMMDD``."""
    return F.unix_date(date_of(day))


def bucketize(value: Column, edges, side: str = "left") -> Column:
    """Bucket number: edges strictly below the value (left) or at most the value (right)."""
    if side not in ("left", "right"):
        raise ValueError("side must be left or right")
    points = sorted(set(edges)) if side == "right" else list(edges)
    if not points:
        return F.when(value.isNotNull(), F.lit(0))
    over = (lambda e: value > F.lit(float(e))) if side == "left" else (
        lambda e: value >= F.lit(float(e))
    )
    return reduce(add, [over(e).cast("int") for e in points])


def duration_regime(duration_ms: Column, hinge_ms: float) -> Column:
    return F.when(duration_ms <= F.lit(float(hinge_ms)), "short").otherwise("long")


def logit(rate: Column, eps: float = 1e-6) -> Column:
    held = F.least(F.greatest(rate, F.lit(eps)), F.lit(1 - eps))
    return F.log(held / (1 - held))

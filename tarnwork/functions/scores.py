"""Weights, intervals, decay and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwork.functions.arrays import js_round

DAY_US = 86_400_000_000
Z = 1.96


def age_days(at: Column, as_of: Column) -> Column:
    """Fractional days from ``at`` to ``as_of``."""
    return (F.unix_micros(as_of) - F.unix_micros(at)) / float(DAY_US)


def recency_weight(at: Column, as_of: Column, grace: int = 30, half_life: int = 180) -> Column:
    age = F.greatest(F.lit(0.0), age_days(at, as_of))
    return F.when(age <= grace, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), (age - grace) / half_life))


def effective_size(total: Column, squares: Column) -> Column:
    return F.when(F.coalesce(squares, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(total * total / squares)


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    """(lower, upper) bound of a rate seen in a sample of size n; (0, 1) without a sample."""
    z2 = Z * Z
    denominator = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / denominator
    margin = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / denominator
    none = n == 0
    return F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - margin)), F.when(none, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + margin))


def grade(score: Column) -> Column:
    return F.when(score < 25, "very_low").when(score < 50, "low").when(score < 70, "moderate").when(score < 85, "high").otherwise("very_high")


def freshness(age: Column, time_sensitive: Column) -> tuple[Column, Column]:
    """(score, status) of evidence that is ``age`` whole days old."""
    grace = F.when(time_sensitive, F.lit(90)).otherwise(F.lit(180))
    half = F.when(time_sensitive, F.lit(180)).otherwise(F.lit(365))
    old = F.greatest(F.lit(0), js_round(100 * F.pow(F.lit(2.0), -(age - grace) / half)))
    score = F.when(age.isNull(), F.lit(40)).when(age <= grace, F.lit(100)).otherwise(old)
    status = F.when(age.isNull(), "unknown").when(age <= grace, "current").when(score >= 50, "aging").otherwise("stale")
    return score, status


def search_freshness(verified: Column, stale_after: Column, as_of: Column) -> Column:
    """The label in search documents: unknown wins if nothing was verified."""
    age = age_days(verified, as_of)
    return F.when(verified.isNull(), "unknown").when(stale_after < as_of, "stale").when(age > 180, "aging").otherwise("current")


def popularity(n: Column, cap: int = 6) -> Column:
    return F.least(F.lit(cap), F.floor(F.log2(n + 1) * 2)).cast("int")

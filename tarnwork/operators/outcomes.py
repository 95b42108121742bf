"""Reported outcomes: who counts, and how sure the counts make us.

Rows have path, user_id, bucket, outcome and at. Everything is an aggregate by path over rows with an explicit
``as_of``; only the influence window needs the rows of a reporter in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnwork.functions.arrays import js_round
from tarnwork.functions.scores import DAY_US, age_days, effective_size, grade, recency_weight, wilson
from tarnwork.operators.folds import fold_in_order

ATTEMPTED = ("solved", "partially_helped", "attempted_failed")
HELPED = ("solved", "partially_helped")
RECENT_DAYS, BASELINE_DAYS, SAFETY_DAYS, INFLUENCE_DAYS = 90, 365, 90, 30


def influence(df: DataFrame, originators: DataFrame | None = None, days: float = INFLUENCE_DAYS, order: str = "outcome_id") -> DataFrame:
    """``df`` with ``influence``: not_evidence, originator_non_independent, duplicate_window or eligible.

    A report is a duplicate if its user and bucket have an eligible one within the days before. Whether that one is
    eligible depends on earlier ones, so the rows of a (path, user, bucket) are folded in order of time.
    """
    rows = df if originators is None else df.join(originators.select("path", "user_id", F.lit(True).alias("__own")).distinct(), ["path", "user_id"], "left")
    own = F.lit(False) if originators is None else F.coalesce("__own", F.lit(False))
    first = F.when(F.col("outcome") == "not_used", "not_evidence").when(own, "originator_non_independent")
    rows = rows.drop("influence").withColumn("__first", first).drop("__own").withColumn("__t", F.unix_micros("at"))
    window = int(days * DAY_US)

    def step(last: int | None, status: str | None, t: int | None) -> tuple[int | None, str]:
        if status is not None:
            return last, status
        if last is not None and t is not None and last >= t - window:
            return last, "duplicate_window"
        return t, "eligible"

    found = fold_in_order(rows, ["path", "user_id", "bucket"], ["__t", order], ["__first", "__t"], "influence", StringType(), None, step)
    return found.drop("__t", "__first")


def measures(as_of: Column) -> dict[str, Column]:
    """Columns that the aggregates below read."""
    attempted, age = F.col("outcome").isin(*ATTEMPTED), age_days(F.col("at"), as_of)
    return {
        "__w": F.when(attempted, recency_weight(F.col("at"), as_of)).otherwise(0.0),
        "__any": F.col("outcome").isin(*HELPED),
        "__full": F.col("outcome") == "solved",
        "__recent": attempted & (age <= RECENT_DAYS),
        "__base": attempted & (age > RECENT_DAYS) & (age <= BASELINE_DAYS),
        "__age": age,
    }


def _interval(weight: Column, success: Column) -> list[Column]:
    """Sums that an interval needs: weights, their squares, and the weights of successes."""
    return [F.sum(weight), F.sum(weight * weight), F.sum(F.when(success, weight).otherwise(0.0))]


def _bounds(name: str) -> tuple[Column, Column, Column]:
    total, squares, hits = (F.col(f"__{name}{i}") for i in range(3))
    n = effective_size(total, squares)
    p = F.when(total == 0, F.lit(0.0)).otherwise(hits / total)
    low, high = wilson(p, n)
    return n, low, high


def confidence(eligible: DataFrame, as_of: Column) -> DataFrame:
    """One row a path: ess, any_low, any_high, full_low, score, grade, and the decline measures.

    ``eligible`` holds the rows that count. All intervals come from one pass.
    """
    rows = eligible.withColumns(measures(as_of))
    w = F.col("__w")
    parts = {
        "any": _interval(w, F.col("__any")),
        "full": _interval(w, F.col("__full")),
        "rec": _interval(F.when(F.col("__recent"), w).otherwise(0.0), F.col("__any")),
        "base": _interval(F.when(F.col("__base"), 1.0).otherwise(0.0), F.col("__any")),
    }
    failed = F.col("__recent") & (F.col("outcome") == "attempted_failed")
    g = rows.groupBy("path").agg(
        *[c.alias(f"__{k}{i}") for k, cs in parts.items() for i, c in enumerate(cs)],
        F.count_if(failed).alias("recent_failures"),
        F.countDistinct(F.when(failed, F.col("user_id"))).alias("failing_users"),
        F.countDistinct(F.when((F.col("outcome") == "misleading_or_unsafe") & (F.col("__age") <= SAFETY_DAYS), F.col("user_id"))).alias("unsafe_users"),
    )
    return graded(g)


def graded(g: DataFrame) -> DataFrame:
    """The intervals, score, grade and trend of paths whose sums are known: __any, __full, __rec and __base (weights,
    squares, successes), recent_failures, failing_users and unsafe_users."""
    ess, any_low, any_high = _bounds("any")
    _, full_low, _ = _bounds("full")
    rec_n, rec_low, _ = _bounds("rec")
    base_n, base_low, _ = _bounds("base")
    g = g.select("path", "recent_failures", "failing_users", "unsafe_users", ess.alias("ess"), any_low.alias("any_low"), any_high.alias("any_high"), full_low.alias("full_low"), rec_n.alias("recent_n"), base_n.alias("base_n"), F.greatest(F.lit(0.0), base_low - rec_low).alias("drop"))
    enough = (F.col("recent_n") >= 5) & (F.col("base_n") >= 10)
    declines = enough & (F.col("drop") >= 0.2) & (F.col("recent_failures") >= 3) & (F.col("failing_users") >= 3)
    score = js_round(100 * (0.65 * F.col("any_low") + 0.35 * F.col("full_low")))
    return g.withColumns(
        {
            "score": score,
            "grade": F.when(F.col("ess") == 0, "unobserved").otherwise(grade(score)),
            "trend": F.when(declines, "declining").when(enough, "stable").otherwise("insufficient"),
            "penalties": F.array_compact(F.array(F.when(F.col("unsafe_users") >= 2, "corroborated_safety"), F.when(declines, "outcome_degradation"))),
        }
    )


def counts(rows: DataFrame, as_of: Column) -> DataFrame:
    """total, effective, excluded, users and counts by class for each path; needs ``influence``."""
    ok = F.col("influence") == "eligible"
    n = lambda *o: F.count_if(ok & F.col("outcome").isin(*o))
    recent = ok & F.col("outcome").isin(*HELPED) & (age_days(F.col("at"), as_of) <= RECENT_DAYS)
    return rows.groupBy("path").agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("effective"),
        F.count_if(~ok).alias("excluded"),
        F.countDistinct(F.when(ok, F.col("user_id"))).alias("users"),
        n("solved").alias("solved"),
        n("partially_helped").alias("partially_helped"),
        n("attempted_failed").alias("attempted_failed"),
        n("incompatible_environment").alias("incompatible"),
        F.count_if(F.col("outcome") == "not_used").alias("not_used"),
        F.count_if(recent).alias("recent_successes"),
    )


def version_distribution(eligible: DataFrame, top: int = 128) -> DataFrame:
    """path, place, bucket, n, solved, failed: buckets by count, then by name."""
    from pyspark.sql import Window

    g = eligible.groupBy("path", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "solved").alias("solved"), F.count_if(F.col("outcome") == "attempted_failed").alias("failed"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "bucket"))
    return g.withColumn("place", place).where(F.col("place") <= top)


def latest_dates(eligible: DataFrame) -> DataFrame:
    at = lambda *o: F.max(F.when(F.col("outcome").isin(*o), F.col("at")))
    return eligible.groupBy("path").agg(at(*HELPED).alias("last_successful"), at("attempted_failed").alias("last_failed"))

"""Outcome confidence kept as a state that a new date scales, so that no old report is read again.

A report's weight is 1 for 30 days and then halves every 180. Beyond those 30 days all weights of a path shrink by the
same factor between two dates, so their sums do too. The state has three tables:

* ``days``: counts and decayed sums by path and UTC day, for the 365 days in which windows still move over a report,
* ``tail``: one row a path, the decayed sums of all older reports at the state's day,
* ``users``: the latest failure and the latest unsafe report by path and user, for 90 days.

So its size is bounded by paths times 366 and by recent reporters, whatever the history. States merge by sums and
maxima, in any order; late reports are merged like new ones. A report merged twice counts twice: drop rereads before.

Dates are whole UTC days, on which all windows begin. A state can be asked for its own day or a later one. Reports
without a date weigh 1 for ever and are in no window, as in ``outcomes.confidence``; they are the rows of ``days``
without a day.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.scores import DAY_US
from tarnwork.operators.outcomes import ATTEMPTED, BASELINE_DAYS, HELPED, RECENT_DAYS, SAFETY_DAYS, graded

GRACE_DAYS, HALF_LIFE_DAYS = 30, 180
_COUNTS, _SUMS = ("n", "helped", "solved", "failed"), ("w", "ww", "wh", "ws")
_EPOCH = datetime.date(1970, 1, 1)


@dataclass(frozen=True)
class State:
    day: datetime.date
    tail: DataFrame
    days: DataFrame
    users: DataFrame


def _number(day: datetime.date) -> int:
    return (day - _EPOCH).days


def _shrink(days: Column) -> Column:
    return F.pow(F.lit(0.5), days / float(HALF_LIFE_DAYS))


def _scaled(factor: Column) -> list[Column]:
    """The sums times ``factor``; squares shrink by its square."""
    return [(F.col(c) * (factor * factor if c == "ww" else factor)).alias(c) for c in _SUMS]


def _sums(columns: tuple[str, ...]) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def _aged(tail: DataFrame, days: DataFrame, users: DataFrame, day: datetime.date) -> State:
    """A state of ``day``: days before its windows go to the tail, users before its safety window go."""
    today = _number(day)
    old = F.col("day") < today - BASELINE_DAYS
    # a day's sums stand for its end, and decay begins GRACE_DAYS after a report
    gone = days.where(old).select("path", *_scaled(_shrink(F.lit(today) - F.col("day") - 1 - GRACE_DAYS)))
    tail = tail.unionByName(gone).groupBy("path").agg(*_sums(_SUMS))
    since = F.timestamp_micros(F.lit((today - max(SAFETY_DAYS, RECENT_DAYS)) * DAY_US))
    recent = F.greatest("failed_at", "unsafe_at") >= since
    return State(day, tail, days.where(~old | F.col("day").isNull()), users.where(recent))


def state(reports: DataFrame, day: datetime.date) -> State:
    """The state on ``day`` of reports with path, user_id, outcome and at."""
    attempted = F.col("outcome").isin(*ATTEMPTED)
    number = F.floor(F.unix_micros("at") / F.lit(DAY_US))
    # micros are divided as integers where it matters: the rest of the day is exact
    rest = ((number + 1) * F.lit(DAY_US) - F.unix_micros("at")) / float(DAY_US)
    w = F.when(attempted, F.coalesce(_shrink(rest), F.lit(1.0))).otherwise(0.0)
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    helped, solved = F.col("outcome").isin(*HELPED), F.col("outcome") == "solved"
    days = (
        reports.select("path", number.cast("long").alias("day"), "outcome", w.alias("__w"))
        .groupBy("path", "day")
        .agg(
            one(attempted).alias("n"),
            one(helped).alias("helped"),
            one(solved).alias("solved"),
            one(F.col("outcome") == "attempted_failed").alias("failed"),
            F.sum("__w").alias("w"),
            F.sum(F.col("__w") * F.col("__w")).alias("ww"),
            F.sum(F.when(helped, F.col("__w")).otherwise(0.0)).alias("wh"),
            F.sum(F.when(solved, F.col("__w")).otherwise(0.0)).alias("ws"),
        )
    )
    latest = lambda o: F.max(F.when(F.col("outcome") == o, F.col("at")))
    users = (
        reports.where(F.col("outcome").isin("attempted_failed", "misleading_or_unsafe") & F.col("user_id").isNotNull() & F.col("at").isNotNull())
        .groupBy("path", "user_id")
        .agg(latest("attempted_failed").alias("failed_at"), latest("misleading_or_unsafe").alias("unsafe_at"))
    )
    none = days.where(F.lit(False)).select("path", *_SUMS)
    return _aged(none, days, users, day)


def merged(a: State, b: State, day: datetime.date | None = None) -> State:
    """Both states as one of ``day`` (default: the later of their days)."""
    last = max(a.day, b.day)
    day = day or last
    if day < last:
        raise ValueError(f"a state of {last} can't be taken back to {day}")
    tail = [s.tail.select("path", *_scaled(F.lit(0.5 ** ((day - s.day).days / HALF_LIFE_DAYS)))) for s in (a, b)]
    days = a.days.unionByName(b.days).groupBy("path", "day").agg(*_sums(_COUNTS), *_sums(_SUMS))
    users = a.users.unionByName(b.users).groupBy("path", "user_id").agg(F.max("failed_at").alias("failed_at"), F.max("unsafe_at").alias("unsafe_at"))
    return _aged(tail[0].unionByName(tail[1]), days, users, day)


def rescored(s: State, day: datetime.date | None = None) -> DataFrame:
    """What ``outcomes.confidence`` gives on ``day`` for all reports in the state."""
    day = day or s.day
    if day < s.day:
        raise ValueError(f"a state of {s.day} can't be asked for {day}")
    today, d = _number(day), F.col("day")
    flat = d.isNull() | (d >= today - GRACE_DAYS)
    shrunk = _shrink(F.lit(today) - d - 1 - GRACE_DAYS)
    weight = lambda count, c, by: F.when(flat, F.col(count).cast("double")).otherwise(F.col(c) * by)
    cell = {"w": weight("n", "w", shrunk), "ww": weight("n", "ww", shrunk * shrunk), "wh": weight("helped", "wh", shrunk), "ws": weight("solved", "ws", shrunk)}
    recent = F.coalesce(d >= today - RECENT_DAYS, F.lit(False))
    base = F.coalesce((d < today - RECENT_DAYS) & (d >= today - BASELINE_DAYS), F.lit(False))
    nil = lambda c, where: F.when(where, c).otherwise(0)
    by_day = s.days.select(
        "path",
        *[c.alias(name) for name, c in cell.items()],
        *[nil(cell[c], recent).cast("double").alias(f"r_{c}") for c in ("w", "ww", "wh")],
        nil(F.col("n"), base).alias("b_n"),
        nil(F.col("helped"), base).alias("b_helped"),
        nil(F.col("failed"), recent).alias("recent_failures"),
    )
    tail = s.tail.select("path", *_scaled(F.lit(0.5 ** ((day - s.day).days / HALF_LIFE_DAYS))))
    since = lambda days: F.timestamp_micros(F.lit((today - days) * DAY_US))
    users = s.users.groupBy("path").agg(
        F.count_if(F.col("failed_at") >= since(RECENT_DAYS)).alias("failing_users"),
        F.count_if(F.col("unsafe_at") >= since(SAFETY_DAYS)).alias("unsafe_users"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    real = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    rows = by_day.unionByName(tail, allowMissingColumns=True).unionByName(users, allowMissingColumns=True)
    g = rows.groupBy("path").agg(
        *[real(c).alias(f"__any{i}") for i, c in enumerate(("w", "ww", "wh"))],
        *[real(c).alias(f"__full{i}") for i, c in enumerate(("w", "ww", "ws"))],
        *[real(f"r_{c}").alias(f"__rec{i}") for i, c in enumerate(("w", "ww", "wh"))],
        *[total(c).cast("double").alias(f"__base{i}") for i, c in enumerate(("b_n", "b_n", "b_helped"))],
        *[total(c).alias(c) for c in ("recent_failures", "failing_users", "unsafe_users")],
    )
    return graded(g)


def saved(s: State, where: str) -> State:
    """Write the state as three Parquet tables under ``where``, a new folder, and return the written one."""
    spark = s.days.sparkSession
    for name in ("tail", "days", "users"):
        getattr(s, name).write.parquet(f"{where}/{name}")
    # last, so a folder with a date is a whole state
    spark.createDataFrame([(s.day,)], "day date").coalesce(1).write.parquet(f"{where}/date")
    return loaded(spark, where)


def loaded(spark: SparkSession, where: str) -> State:
    """A state that ``saved`` wrote."""
    day = spark.read.parquet(f"{where}/date").first()["day"]
    return State(day, *(spark.read.parquet(f"{where}/{name}") for name in ("tail", "days", "users")))

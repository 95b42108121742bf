"""Roll-ups and guards of processing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_status(steps: DataFrame, run: str) -> DataFrame:
    """run, total and status of each run from the statuses of its steps."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    g = steps.groupBy(run).agg(
        F.count("*").alias("total"),
        n("active", "retrying").alias("active"),
        n("completed").alias("completed"),
        n("failed").alias("failed"),
        n("quarantined").alias("quarantined"),
    )
    ended = F.col("completed") + F.col("failed") + F.col("quarantined") == F.col("total")
    done = (
        F.when(F.col("quarantined") > 0, "quarantined")
        .when((F.col("failed") > 0) & (F.col("completed") > 0), "partially_completed")
        .when(F.col("failed") > 0, "failed")
        .otherwise("completed")
    )
    return g.select(run, "total", F.when(ended, done).when(F.col("active") > 0, "running").otherwise("queued").alias("status"))


#: Attempts by job; other jobs have DEFAULT_ATTEMPTS.
ATTEMPTS = {"source.github.sync": 5, "source.official.sync": 5, "source.extract": 4, "record.reembed": 4, "development.fail": 3}
DEFAULT_ATTEMPTS = 5


def after_failure(job: Column, attempts: Column) -> Column:
    """The step's state after a failed attempt."""
    most = F.coalesce(*[F.when(job == j, F.lit(n)) for j, n in ATTEMPTS.items()], F.lit(DEFAULT_ATTEMPTS))
    return F.when(attempts >= most, "quarantined").otherwise("retrying")

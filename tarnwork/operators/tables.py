"""Change detection, latest rows, sinks and guarded updates, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """For each key the row with the greatest ``order``; only ``carry`` and the order travel through the aggregate."""
    best = F.max_by(F.struct(*carry), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def missing(wanted: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose key ``known`` lacks."""
    return wanted.join(known.select(*on), on, "left_anti")


def changes(now: DataFrame, before: DataFrame, on: list[str], digest: str = "digest") -> DataFrame:
    """``now`` with ``change``: created, updated or unchanged against the previous digests."""
    old = before.select(*on, F.col(digest).alias("__old"), F.lit(True).alias("__had"))
    change = F.when(F.col("__had").isNull(), "created").when(F.col("__old") == F.col(digest), "unchanged").otherwise("updated")
    return now.join(old, on, "left").withColumn("change", change).drop("__old", "__had")


def successive_changes(df: DataFrame, keys: list[str], order: list[str], digest: str = "digest") -> DataFrame:
    """``change`` of each revision against the one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    old = F.lag(digest).over(w)
    change = F.when(F.row_number().over(w) == 1, "created").when(old == F.col(digest), "unchanged").otherwise("updated")
    return df.withColumn("change", change)


def insert_absent(new: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Rows to append: keys not stored yet, one row for each key (the one that sorts first)."""
    first = F.row_number().over(Window.partitionBy(*on).orderBy(*[c for c in new.columns if c not in on])) if set(new.columns) - set(on) else F.lit(1)
    return missing(new.withColumn("__n", first).where("__n = 1").drop("__n"), stored, on)


def upsert(stored: DataFrame, new: DataFrame, on: list[str], insert_only: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows with the fields that new rows give, and new rows; ``insert_only`` fields of stored rows stay."""
    both = stored.alias("o").join(new.alias("n"), on, "full_outer")
    had = F.col("o.__had")
    both = stored.withColumn("__had", F.lit(True)).alias("o").join(new.alias("n"), on, "full_outer")
    fields = [c for c in stored.columns if c not in on]
    values = [
        (F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in insert_only else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).alias(c)
        for c in fields
        if c in new.columns
    ] + [F.col(f"o.{c}") for c in fields if c not in new.columns]
    return both.select(*on, *values)


def transition(status: Column, allowed: list[str], to: Column) -> Column:
    """The new status where the current one allows it."""
    return F.when(status.isin(*allowed), to).otherwise(status)


def set_difference(wanted: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Keys with ``action``: upsert for wanted ones, remove for existing ones that are not wanted."""
    put = wanted.select(*on).distinct().withColumn("action", F.lit("upsert"))
    return put.unionByName(missing(existing.select(*on).distinct(), wanted, on).withColumn("action", F.lit("remove")))


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """The last non-null ``value`` up to each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))

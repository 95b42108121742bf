"""Interval counts without pairs, and ranks over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.plans.shared import written


def range_count(asked: DataFrame, rows: DataFrame, keys: list[str], at: str, back: int, ahead: int, row_id: str, out: str) -> DataFrame:
    """For each asked row, how many rows of its key lie from ``back`` before to ``ahead`` after it (long times).

    Both sides meet in one window by key, so no pair is formed.
    """
    marked = asked.select(*keys, at, row_id, F.lit(0).alias("__n")).unionByName(rows.select(*keys, at, F.lit(1).alias("__n")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-back, ahead)
    counted = marked.withColumn(out, F.sum("__n").over(w))
    return counted.where("__n = 0").select(row_id, F.col(out).cast("long").alias(out))


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with its rank from 1 by ``order`` over all rows, in two levels and without a window in one task.

    Rows are cut into ranges of ``order`` and written; each range is ranked by itself and moved by the rows of the
    ranges before it. Only one count a range meets in one task. Rows that tie get ranks of their own, in any order.
    """
    cut = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked")
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = cut.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return cut.join(F.broadcast(moved), "__range").withColumn(out, place + F.col("__before")).drop("__range", "__before")

"""Cursors, limits and folds over event tables, and the same as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tarnwork.operators.folds import fold_in_order


def since_cursor(df: DataFrame, at: str, cursor: str, overlap_hours: int = 24) -> DataFrame:
    """Rows at or after the cursor less an overlap that catches late ones."""
    return df.where(F.col(at) >= F.expr(f"timestamp'{cursor}' - interval {overlap_hours} hours"))


def fresh_revisions(df: DataFrame, seen: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose (key, digest) was not stored before: re-read rows that did not change fall away."""
    return df.join(seen.select(key, digest).distinct(), [key, digest], "left_anti")


def rate_gate(df: DataFrame, key: str, at: str, seconds: int, most: int, order: str) -> DataFrame:
    """``df`` with ``allowed``: at most ``most`` rows of a key in a window that begins with its first row.

    The next window begins with the first row after the last one ended, so a key's rows are folded in order.
    """
    rows = df.drop("allowed").withColumn("__t", F.unix_micros(at))

    def step(state: tuple[int | None, int], t: int) -> tuple[tuple[int | None, int], bool]:
        start, n = state
        start, n = (t, 1) if start is None or t >= start + seconds * 1_000_000 else (start, n + 1)
        return (start, n), n <= most

    return fold_in_order(rows, [key], ["__t", order], ["__t"], "allowed", BooleanType(), (None, 0), step).drop("__t")


def trailing_count(df: DataFrame, keys: list[str], at: str, seconds: int, out: str) -> DataFrame:
    """Rows of the key in the seconds before each row, itself and rows of the same moment left out."""
    w = Window.partitionBy(*keys).orderBy("__t").rangeBetween(-seconds * 1_000_000, -1)
    return df.withColumn("__t", F.unix_micros(at)).withColumn(out, F.count("*").over(w)).drop("__t")


def calendar_day_count(df: DataFrame, keys: list[str], at: str, order: str, out: str) -> DataFrame:
    """Earlier rows of the key on the same UTC day."""
    w = Window.partitionBy(*keys, F.to_date(at)).orderBy(at, order)
    return df.withColumn(out, F.row_number().over(w) - 1)


def greedy_prefix(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """``df`` with ``kept``: rows are taken in order while their sizes fit; one that does not fit is skipped."""
    def step(left: int, n: int) -> tuple[int, bool]:
        return (left - n, True) if n <= left else (left, False)

    return fold_in_order(df.drop("kept"), [key], [order], [size], "kept", BooleanType(), budget, step)


def _write_batch(df: DataFrame, out: str, batch: int) -> None:
    """A batch that runs again replaces its own folder, so its rows are there once."""
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def _started(rows: DataFrame, out: str, checkpoint: str, mode: str):
    write = lambda df, batch: _write_batch(df, out, batch)
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def stream_revisions(rows: DataFrame, at: str, keys: list[str], out: str, checkpoint: str, delay: str = "24 hours"):
    """Start a stream that writes each (keys) of ``rows`` once to Parquet folders under ``out``, one for each batch.

    ``rows`` is a streaming frame in which rows come again: a reread overlaps the one before by up to ``delay``. Keys
    are an id and a digest, so an unchanged row falls away and a changed one passes. Keys are remembered until the
    watermark passes their ``at`` by ``delay``, so the state holds the overlap and not the history. Rows older than the
    watermark, and rows without ``at``, are not written. Stops when all present files
    are read; started again with the same ``checkpoint`` and ``out``, it goes on after the last whole batch.
    """
    fresh = rows.where(F.col(at).isNotNull()).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
    return _started(fresh, out, checkpoint, "append")


def stream_counts(spark: SparkSession, path: str, schema, at: str, key: str, checkpoint: str, out: str, delay: str = "24 hours", width: str = "1 day"):
    """Start a stream over Parquet files that counts rows by key and window, with late rows up to ``delay``.

    Each batch writes the windows that it changed to a folder of its own under ``out``; ``latest_counts`` reads them.
    Stops when all present files are read.
    """
    rows = spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))
    counted = rows.withWatermark(at, delay).groupBy(F.window(at, width), key).count()
    return _started(counted, out, checkpoint, "update")


def latest_counts(spark: SparkSession, out: str, key: str) -> DataFrame:
    """window, key, count as the last batch that changed them left them."""
    rows = spark.read.parquet(out)
    return rows.groupBy("window", key).agg(F.max_by("count", "batch").alias("count"))

"""All stored diagnostics that texts hold, found by joins.

A diagnostic counts where it stands between word borders, so its words are whole words of the text, in a row. Each
diagnostic is looked up by one run of words: all of its own, or, of those longer than ``RUN`` words, the run of that
many that the fewest texts hold. So what a lookup finds is the diagnostic itself, however many share its words, and
every hit is verified. No dictionary is broadcast: it may be larger than a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.search import embedded_diagnostic, telling_diagnostic, trimmed_diagnostic
from tarnwork.plans.shared import written


def _words(c: Column) -> Column:
    return F.filter(F.split(c, "[^A-Za-z0-9_$]+"), lambda w: w != "")


#: Words of a run at most; a text has a run from every word on for each length that diagnostics are looked up by.
RUN = 16


def _runs(words: Column, length: Column | int) -> Column:
    """Hashes of all runs of so many words; equal hashes of unequal runs are caught when a hit is verified."""
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.sequence(F.lit(1), F.size(words) - length + 1)
    return F.when(F.size(words) >= length, F.transform(starts, lambda at: F.xxhash64(F.slice(words, at, length)))).otherwise(F.array().cast("array<bigint>"))


def embedded(texts: DataFrame, stored: DataFrame, text_id: str, text: str, diagnostic: str) -> DataFrame:
    """(text_id, diagnostic): each distinct stored diagnostic, without its closing marks, that a text holds.

    Both columns are normalised (``error_text``). Diagnostics that are short, name no failure or have no mark are left
    out, as ``embedded_diagnostic`` does; nulls and texts without words hold nothing. Ids must be unique. Rows that store
    the same diagnostic join to its text (``trimmed_diagnostic``), so a hot one is searched once.
    """
    known = stored.where(telling_diagnostic(F.col(diagnostic))).select(trimmed_diagnostic(F.col(diagnostic)).alias("diagnostic")).distinct()
    words = known.withColumn("w", _words(F.col("diagnostic"))).withColumn("length", F.least(F.size("w"), F.lit(RUN))).where("length > 0")
    known = written(words.select("diagnostic", "length", F.explode(F.array_distinct(_runs(F.col("w"), F.col("length")))).alias("key")), "diagnostic-keys")
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())  # RUN rows at most
    read = texts.select(F.col(text_id).alias("id"), _words(F.col(text)).alias("w"))
    keys = read.select("id", F.explode(F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[_runs(F.col("w"), n) for n in lengths]))).alias("key"))
    hits = written(keys.join(known.select("key").distinct(), "key", "left_semi"), "diagnostic-hits")
    held = hits.groupBy("key").agg(F.count("*").alias("n"))
    rarest = known.join(held, "key", "left").groupBy("diagnostic").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    found = hits.join(rarest, "key").select(F.col("id").alias("__id"), F.col("diagnostic").alias("__d"))
    body = texts.select(F.col(text_id).alias("__id"), F.col(text).alias("__text"))
    seen = found.join(body, "__id").where(F.contains("__text", "__d") & embedded_diagnostic(F.col("__text"), F.col("__d")))
    return seen.select(F.col("__id").alias(text_id), F.col("__d").alias("diagnostic"))

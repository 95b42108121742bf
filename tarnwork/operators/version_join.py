"""Which asked version constraints fit which stored ones, as joins instead of a comparison of every pair.

Values become intervals of order-preserving keys. All ends are ranked once; an interval is then a run of ranks, cut
into at most two nodes of a binary tree a level, and a start is a path of that tree. Two intervals overlap just when
one holds the other's start, so node and path meet in an equality join, once for each overlap and never otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from tarnwork.functions import versions
from tarnwork.plans.ranges import ranked
from tarnwork.plans.shared import written

_SPAN = StructType([StructField("low", StringType()), StructField("high", StringType())])
_READ = StructType([StructField("same", StringType()), StructField("number", StringType()), StructField("ranged", BooleanType()), StructField("spans", ArrayType(_SPAN))])


def _digits(n: int) -> str:
    """Decimal digits behind their count, so that text order is the order of the numbers."""
    text = str(n)
    return f"{len(text):03d}{text}"


def _key(version: tuple) -> str:
    """Text that sorts as the version does; no key is a prefix of another."""
    if version[0] == float("inf"):
        return "~"
    parts = ""
    for p in version[3]:
        parts += "4" if p[0] else f"2{_digits(p[1])}" if p[2] == "" else f"3{p[2]}\x01"
    return "".join(_digits(n) for n in version[:3]) + (parts if parts == "4" else parts + "1")


def _read(value: str) -> tuple:
    plain = re.sub("^v", "", value.strip())
    sets, number = versions.parse_range(plain), re.search(r"(\d+)", plain)
    spans = [(_key(low) + ("0" if low_in else "2"), _key(high) + ("2" if high_in else "0")) for low, low_in, high, high_in, _ in sets or ()]
    return plain.lower(), number and number[1], sets is not None, [s for s in spans if s[0] < s[1]]


@F.pandas_udf(_READ)
def _parsed(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(v) for v in values], columns=["same", "number", "ranged", "spans"])


def _shifted(rank: Column, k: Column) -> Column:
    return F.call_function("shiftright", rank, k)


def _nodes(low: Column, high: Column, levels: int) -> Column:
    """The tree nodes that cover the ranks from ``low`` up to and without ``high``."""

    def of_level(k: Column) -> Column:
        left, right = -_shifted(-low, k), _shifted(high, k)
        node = lambda cond, v: F.when((left < right) & cond, F.struct(k.alias("level"), v.alias("node")))
        return F.array(node(left % 2 == 1, left), node(right % 2 == 1, right - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level)))


def _path(rank: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), _shifted(rank, k).alias("node")))


def _overlaps(read: DataFrame) -> DataFrame:
    """(subject, asked, stored) of the ranged values of one subject that share a version; pairs may repeat."""
    spans = read.where("ranged").select("subject", "asks", "value", F.inline("spans"))
    ends = spans.select("subject", F.explode(F.array("low", "high")).alias("end")).distinct()
    places = written(ranked(ends, ["subject", "end"], "place"), "version-ends")
    levels = max(places.count(), 1).bit_length()
    at = lambda c, n: places.select("subject", F.col("end").alias(c), F.col("place").cast("long").alias(n))
    spans = written(spans.join(at("low", "from"), ["subject", "low"]).join(at("high", "to"), ["subject", "high"]).select("asks", "subject", "value", "from", "to"), "version-spans")
    a, s = spans.where("asks"), spans.where("not asks")

    def held(holds: DataFrame, starts: DataFrame, low: Column, named: tuple[str, str]) -> DataFrame:
        runs = holds.select("subject", F.col("value").alias(named[0]), F.inline(_nodes(low, F.col("to"), levels)))
        paths = starts.select(F.col("value").alias(named[1]), F.inline(_path(F.col("from"), levels)))
        return runs.join(paths, ["level", "node"]).select("subject", "asked", "stored")

    return held(a, s, F.col("from"), ("asked", "stored")).unionByName(held(s, a, F.col("from") + 1, ("stored", "asked")))


def fitting_values(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct (subject, asked, stored, fit) of the values of one subject, whatever its case, that fit: ``exact`` or ``compatible``.

    Both inputs have subject and value; rows with a null in either say nothing. Two ranges fit if they overlap; where one
    side is no range, the first whole numbers must be equal. Pairs that are not returned are incompatible or unknown.
    """
    sides = [df.select(F.lower("subject").alias("subject"), "value", F.lit(asks).alias("asks")).where("subject is not null and value is not null").distinct() for df, asks in ((asked, True), (stored, False))]
    read = written(sides[0].unionByName(sides[1]).withColumn("r", _parsed("value")).select("subject", "value", "asks", "r.*"), "version-values")
    take = lambda asks, name: read.where("asks" if asks else "not asks").select("subject", F.col("value").alias(name), F.col("same").alias(f"{name}_same"), "number", F.col("ranged").alias(f"{name}_ranged"))
    a, s = take(True, "asked"), take(False, "stored")
    exact = a.join(s.drop("number"), (a["subject"] == s["subject"]) & (a["asked_same"] == s["stored_same"])).select(a["subject"], "asked", "stored", F.lit("exact").alias("fit"))
    numbered = [x.join(y, ["subject", "number"]) for x, y in ((a.where("not asked_ranged"), s), (a.where("asked_ranged"), s.where("not stored_ranged")))]
    pairs = reduce(DataFrame.unionByName, [n.select("subject", "asked", "stored") for n in numbered], _overlaps(read))
    return exact.unionByName(pairs.withColumn("fit", F.lit("compatible"))).groupBy("subject", "asked", "stored").agg(F.max("fit").alias("fit"))


def set_key(entries: Column) -> Column:
    """One key for equal lists of constraints (array<struct<subject, value>>)."""
    return F.sha2(F.to_json(entries).cast("binary"), 256)


def fitting_sets(asked: DataFrame, stored: DataFrame, entries: str) -> DataFrame:
    """(asked_set, stored_set, fit) of the distinct lists of constraints that fit; ``set_key`` joins rows to them.

    The first pair that is exact or compatible decides, in the order of the asked list, then of the stored one. Equal
    lists are compared once, however many rows have them. Null and empty lists fit nothing.
    """
    def listed(df: DataFrame, name: str) -> DataFrame:
        sets = df.where(F.size(entries) > 0).select(set_key(F.col(entries)).alias(f"{name}_set"), F.col(entries).alias("e")).dropDuplicates([f"{name}_set"])
        rows = sets.select(f"{name}_set", F.posexplode("e").alias(f"{name}_at", "c"))
        return rows.select(f"{name}_set", f"{name}_at", F.lower("c.subject").alias("subject"), F.col("c.value").alias(name))

    a, s = listed(asked, "asked"), listed(stored, "stored")
    pairs = fitting_values(a.withColumnRenamed("asked", "value"), s.withColumnRenamed("stored", "value"))
    met = pairs.join(a, ["subject", "asked"]).join(s, ["subject", "stored"])
    return met.groupBy("asked_set", "stored_set").agg(F.min_by("fit", F.struct("asked_at", "stored_at")).alias("fit"))

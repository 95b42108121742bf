"""Similarities and set operations on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets; two empty ones are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared members over the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def listed_overlap(a: Column, b: Column) -> Column:
    """Members of ``a`` (repeats count) that ``b`` has, over the longer list; 0 if either is empty."""
    longest = F.greatest(F.size(a), F.size(b))
    shared = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / longest)


def sorted_distinct(a: Column, drop_empty: bool = False) -> Column:
    out = F.array_sort(F.array_distinct(a))
    return F.filter(out, lambda x: x != "") if drop_empty else out


def merge_ranges(a: Column) -> Column:
    """Ranges array<struct<s, e>> sorted by start, with those that meet or overlap made one."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= F.get(acc, F.size(acc) - 1)["e"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(a), F.array().cast("array<struct<s:bigint,e:bigint>>"), step)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length; null if the dimensions differ or there are none."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def js_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5).cast("int")

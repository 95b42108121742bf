"""A join of many rows to facts of their key, where one key may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HOT_SHARE of the rows is hot, so there are fewer hot keys than this.
HOT_SHARE = 500


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the other columns of ``facts``, which has one row for each ``key`` and its ``count`` of rows.

    Rows of hot keys stay where they are and meet their facts in a broadcast, whose size the share bounds; only the
    rest is dealt out by key. ``facts`` is read three times, so it should be a written table; keys are not null.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > max(total // HOT_SHARE, 1)
    hot, rest = facts.where(is_hot).drop(count), facts.where(~is_hot).drop(count)
    few = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(few, key, "left_anti").join(rest, key))

"""Which embedding inputs a budget of provider calls pays for, and which ones reuse a stored or a shared result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.plans.ranges import ranked


def planned_calls(inputs: DataFrame, stored: DataFrame, digest: str, order: str, calls: int, allowed: Column | None = None) -> DataFrame:
    """``inputs`` with ``state`` and ``call``, as one pass over them in ``order`` (a unique column) would decide.

    reused: the digest is in ``stored``; computed: the first input of its digest, within the ``calls`` that the
    budget has; shared: a later input of such a digest; exhausted: no call was left for the digest; forbidden: not
    ``allowed`` to leave (it neither makes nor gets a call); no_input: no digest. ``call`` is the number of the
    digest's call from 1, null without one; it goes on beyond the budget, so a larger budget can be read off.

    A digest takes a call where it first occurs, and none later, so calls are ranks of first occurrences. The digests
    are reduced before they are ranked; a digest that many inputs share is one row there, and on the way back its
    inputs stay on the split side of an outer join, which adaptive execution can divide.
    """
    rows = inputs.drop("state", "call").withColumn("__may", F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False)))
    asking = rows.where(F.col("__may") & F.col(digest).isNotNull()).groupBy(digest).agg(F.min(order).alias("__first"))
    have = stored.where(F.col(digest).isNotNull()).select(digest).distinct()
    fresh = ranked(asking.join(have, digest, "left_anti"), ["__first"], "call").withColumn("call", F.col("call").cast("long"))
    found = rows.join(fresh, digest, "left")
    state = (
        F.when(F.col(digest).isNull(), "no_input")
        .when(~F.col("__may"), "forbidden")
        .when(F.col("call").isNull(), "reused")
        .when(F.col("call") > calls, "exhausted")
        .when(F.col(order) == F.col("__first"), "computed")
        .otherwise("shared")
    )
    call = F.when(F.col("__may"), F.col("call"))
    return found.withColumn("state", state).withColumn("call", call).select(*inputs.drop("state", "call").columns, "state", "call")

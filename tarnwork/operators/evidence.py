"""Evidence scores: signals as long rows, summed and capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.arrays import js_round
from tarnwork.functions.scores import grade, popularity

#: Signal, points and strength.
SIGNALS = {
    "grounded_extraction": (20, "moderate"),
    "agent_self_report": (5, "weak"),
    "official_solution_guidance": (40, "decisive"),
    "maintainer_solution": (28, "strong"),
    "accepted_discussion_answer": (24, "strong"),
    "author_confirmed": (20, "strong"),
    "merged_closing_pull_request": (15, "strong"),
    "closed_after_solution": (5, "weak"),
    "authoritative_conflict": (-35, "strong"),
    "community_conflict": (-15, "moderate"),
    "unsupported_candidate_label": (-10, "moderate"),
}
WEAK_CAP, CONFLICT_CAP, STALE_CAP, VERY_HIGH_CAP, SELF_REPORT_CAP = 55, 69, 69, 84, 34


def signals(rows: DataFrame, key: str, present: dict[str, Column], popular: Column, unpopular: Column, roots: Column) -> DataFrame:
    """(key, signal, points, strength) of rows that have a column for what each signal needs.

    present: how often each signal of SIGNALS applies (a count, or a boolean as 0 and 1); a signal that is per item
    gets its points once for each, the others once.
    """
    each = ("authoritative_conflict", "community_conflict", "unsupported_candidate_label")
    made = []
    for name, times in present.items():
        points, strength = SIGNALS[name]
        n = times.cast("int")
        got = F.when(n > 0, n * points if name in each else F.lit(points))
        made.append(F.struct(F.lit(name).alias("signal"), got.cast("int").alias("points"), F.lit(strength).alias("strength")))
    likes, dislikes = F.when(popular > 0, popularity(popular)), F.when(unpopular > 0, -popularity(unpopular))
    converge = F.when(roots >= 2, F.least(F.lit(15), (roots - 1) * 5).cast("int"))
    for name, points, strength in (("solution_popularity", likes, "weak"), ("negative_popularity", dislikes, "weak"), ("independent_source_convergence", converge, "moderate")):
        made.append(F.struct(F.lit(name).alias("signal"), points.cast("int").alias("points"), F.lit(strength).alias("strength")))
    return rows.select(key, F.inline(F.filter(F.array(*made), lambda s: s["points"].isNotNull())))


def source_evidence(found: DataFrame, key: str) -> DataFrame:
    """positive, negative, weak, source score, and what the caps of the final score ask for, by key."""
    strong = (F.col("points") > 0) & F.col("strength").isin("strong", "decisive")
    g = found.groupBy(key).agg(
        F.sum(F.when(F.col("points") > 0, F.col("points")).otherwise(0)).cast("int").alias("positive"),
        F.sum(F.when(F.col("points") < 0, F.col("points")).otherwise(0)).cast("int").alias("negative"),
        F.count_if(strong).alias("strong"),
        F.count_if(strong & (F.col("strength") == "decisive")).alias("decisive"),
        F.count_if(F.col("signal") == "authoritative_conflict").alias("conflicts"),
        F.count_if(F.col("signal") == "agent_self_report").alias("self_reports"),
    )
    plain = F.greatest(F.lit(0), F.least(F.lit(100), F.col("positive") + F.col("negative")))
    return g.withColumn("weak", F.col("strong") == 0).withColumn("source", F.when(F.col("strong") == 0, F.least(plain, F.lit(WEAK_CAP))).otherwise(plain))


def version_fit(mine: Column, theirs: Column, official: Column) -> Column:
    """Points for how a candidate's versions meet its sources'."""
    both = (F.size(mine) > 0) & (F.size(theirs) > 0)
    either = (F.size(mine) > 0) | (F.size(theirs) > 0)
    return F.when(both, F.when(F.arrays_overlap(mine, theirs), 100).otherwise(10)).when(either, 55).when(official, 75).otherwise(40)


def final_score(source: Column, fresh: Column, version: Column, strong: Column, decisive: Column, conflicts: Column, stale: Column, self_reports: Column) -> Column:
    score = js_round((70 * source + 20 * fresh + 10 * version) / 100)
    score = F.when((score >= 85) & (decisive == 0) & (strong < 2), F.least(score, F.lit(VERY_HIGH_CAP))).otherwise(score)
    score = F.when(conflicts > 0, F.least(score, F.lit(CONFLICT_CAP))).otherwise(score)
    score = F.when(stale, F.least(score, F.lit(STALE_CAP))).otherwise(score)
    return F.when(self_reports > 0, F.least(score, F.lit(SELF_REPORT_CAP))).otherwise(score)


def integrity(refs: DataFrame, items: DataFrame, on: str, key: str) -> DataFrame:
    """(key, eligible, broken): references without an item, of another visibility, or with another digest break a key.

    refs: key, on, visibility, digest. items: on, item_visibility, item_digest.
    """
    j = refs.join(items.withColumn("__has", F.lit(True)), on, "left")
    bad = F.col("__has").isNull() | (F.col("visibility") != F.col("item_visibility")) | (F.col("digest") != F.col("item_digest"))
    return j.groupBy(key).agg((~F.bool_or(bad)).alias("eligible"), F.count_if(bad).alias("broken"))


__all__ = ["SIGNALS", "final_score", "grade", "integrity", "signals", "source_evidence", "version_fit"]

"""Changes of canonical records after their first merge: attach, conflict, split, reassign, rebuild and archive.

Memberships are a versioned table: a row says that a candidate belonged to a record from one change up to another.
Changes come as a log of ordered events. Whether an event counts depends on its candidate's own events only: after an
attach a candidate has a record, after a split it has none, and a reassignment changes nothing about that. So one
window over the candidates named in the log settles every event, without a fold and without the rest of the table.
Records are then rebuilt only where a member came or went; those without supporting members are archived.

Operations already applied are skipped, so a log can be sent again after a lost job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events. A conflict adds a conflicting member beside the supporting ones.
KINDS = ("attach", "conflict", "split", "reassign")

_MEMBER = ["candidate_id", "record_id", "disposition", "solution_key", "since", "until"]


@dataclass(frozen=True)
class Change:
    """What a log of events did: all events with their outcome, the new membership table, and the records it touched."""

    events: DataFrame
    memberships: DataFrame
    records: DataFrame


def active(memberships: DataFrame) -> DataFrame:
    """Memberships that no change has ended."""
    return memberships.where("until is null")


def settled(memberships: DataFrame, events: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Events with ``outcome`` (applied, rejected, unchanged or repeated) and ``from_record``, the candidate's record before.

    Events: operation_id, sequence (tells events of a candidate apart), kind, candidate_id, record_id (none for a split)
    and solution_key. Rejected are an attach of a candidate that has a supporting membership, a split or reassignment
    of one that has none, an attach, conflict or reassignment without a record, and unknown kinds. A conflict that is
    there already changes nothing. Of events with one operation_id the first counts; those in ``applied`` are repeats. Events
    without an operation_id are never repeats.
    """
    once = F.row_number().over(Window.partitionBy("operation_id").orderBy("sequence", "kind", "candidate_id"))
    log = events.withColumn("__again", F.col("operation_id").isNotNull() & (once > 1))
    if applied is not None:
        done = applied.select("operation_id").distinct().withColumn("__done", F.lit(True))
        log = log.join(done, "operation_id", "left").withColumn("__again", F.col("__again") | F.coalesce("__done", F.lit(False))).drop("__done")
    names = log.select("candidate_id").distinct()
    held = active(memberships).join(names, "candidate_id", "left_semi")
    first = held.where("disposition = 'supporting'").groupBy("candidate_id").agg(F.min("record_id").alias("__first"))
    rows = log.join(first, "candidate_id", "left")
    whole = F.col("kind").isin(*KINDS) & (F.col("record_id").isNotNull() | (F.col("kind") == "split")) & ~F.col("__again")
    by = Window.partitionBy("candidate_id").orderBy("sequence", "operation_id").rowsBetween(Window.unboundedPreceding, -1)
    owns = F.when(whole & (F.col("kind") == "attach"), True).when(whole & (F.col("kind") == "split"), False)
    has = F.coalesce(F.last(owns, ignorenulls=True).over(by), F.col("__first").isNotNull())
    rows = rows.withColumn("__has", has)
    ok = whole & F.when(F.col("kind") == "attach", ~F.col("__has")).when(F.col("kind") == "conflict", True).otherwise(F.col("__has"))
    rows = rows.withColumn("__ok", ok)
    goes = F.when(F.col("__ok") & F.col("kind").isin("attach", "reassign"), F.col("record_id"))
    rows = rows.withColumn("from_record", F.when(F.col("__has"), F.coalesce(F.last(goes, ignorenulls=True).over(by), F.col("__first"))))
    there = held.where("disposition = 'conflicting'").select("candidate_id", "record_id").distinct().withColumn("__there", F.lit(True))
    pair = Window.partitionBy("candidate_id", "record_id").orderBy("sequence", "operation_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(there, ["candidate_id", "record_id"], "left")
    before = F.coalesce(F.max(F.col("__ok") & (F.col("kind") == "conflict")).over(pair), F.lit(False)) | F.coalesce("__there", F.lit(False))
    outcome = F.when(F.col("__again"), "repeated").when(~F.coalesce("__ok", F.lit(False)), "rejected").when((F.col("kind") == "conflict") & before, "unchanged").otherwise("applied")
    return rows.withColumn("outcome", outcome).select(*events.columns, "from_record", "outcome")


def summary(memberships: DataFrame) -> DataFrame:
    """record_id, supporting and conflicting (counts), representative (smallest supporting candidate) and digest of active members.

    The digest does not depend on order, so a record is never gathered in one place.
    """
    support = F.col("disposition") == "supporting"
    h = F.xxhash64("candidate_id", "disposition", "solution_key")
    return active(memberships).groupBy("record_id").agg(F.count_if(support).alias("supporting"), F.count_if(~support).alias("conflicting"), F.min(F.when(support, F.col("candidate_id"))).alias("representative"), F.hex(F.bit_xor(h)).alias("digest"))


def rebuilt(records: DataFrame, memberships: DataFrame) -> DataFrame:
    """``records`` (record_id) with their summary and status: archived where nothing supports them, else active."""
    found = records.select("record_id").distinct().join(summary(memberships), "record_id", "left").fillna(0, ["supporting", "conflicting"])
    return found.withColumn("status", F.when(F.col("supporting") > 0, "active").otherwise("archived"))


def changed(memberships: DataFrame, events: DataFrame, applied: DataFrame | None = None) -> Change:
    """Apply a log of events. ``since`` and ``until`` of memberships are sequences of events; null is the time before, and open.

    Only candidates of the log are looked at and only records that gain or lose a member are rebuilt; all other
    memberships stay as they are.
    """
    log = settled(memberships, events, applied)
    moves = log.where("outcome = 'applied' and kind <> 'conflict'")
    next_move = F.lead("sequence").over(Window.partitionBy("candidate_id").orderBy("sequence", "operation_id"))
    opened = moves.withColumn("until", next_move).where("kind <> 'split'")
    opened = opened.select("candidate_id", "record_id", F.lit("supporting").alias("disposition"), "solution_key", F.col("sequence").alias("since"), "until")
    against = log.where("outcome = 'applied' and kind = 'conflict'").select("candidate_id", "record_id", F.lit("conflicting").alias("disposition"), "solution_key", F.col("sequence").alias("since"), F.lit(None).cast("long").alias("until"))
    ends = moves.where("from_record is not null").groupBy("candidate_id").agg(F.min("sequence").alias("__end"))
    kept = memberships.select(_MEMBER).join(ends, "candidate_id", "left")
    ended = F.when(F.col("until").isNull() & (F.col("disposition") == "supporting"), F.col("__end")).otherwise(F.col("until"))
    after = kept.withColumn("until", ended).select(_MEMBER).unionByName(opened).unionByName(against)
    done = log.where("outcome = 'applied'")
    touched = done.select("record_id").union(done.select("from_record")).where("record_id is not null").distinct()
    return Change(log, after, rebuilt(touched, after.join(touched, "record_id", "left_semi")))


def at(memberships: DataFrame, sequence: int) -> DataFrame:
    """Memberships as they were after the event of that sequence, open."""
    seen = memberships.where((F.coalesce("since", F.lit(-(1 << 62))) <= sequence) & (F.coalesce("until", F.lit(1 << 62)) > sequence))
    return seen.withColumn("until", F.lit(None).cast("long"))

"""Quality, routing and state of contributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwork.functions.text import BOUNDARY as B
from tarnwork.functions.text import word_count

#: Patterns of the quality gate.
TRIVIAL = (
    rf"(?i){B}(missing|extra)\s+semicolon{B}",
    rf"(?i){B}typo{B}|{B}misspell(?:ed|ing)?{B}",
    rf"(?i){B}wrong\s+(?:local\s+)?import{B}",
    rf"(?i){B}rename(?:d)?\s+(?:a\s+)?(?:local\s+)?variable{B}",
    rf"(?i){B}css\s+(?:color|spacing|margin|padding){B}",
    rf"(?i){B}forgot\s+(?:a\s+)?local\s+(?:environment|env)\s+variable{B}",
)
RISKY = (
    rf"(?i){B}rm\s+-rf{B}",
    rf"(?i){B}chmod\s+777{B}",
    rf"(?i){B}curl{B}[^\n|]{{0,240}}\|\s*(?:sh|bash){B}",
    rf"(?i){B}disable\s+(?:ssl|tls|certificate|security|authentication){B}",
    rf"(?i)--no-verify{B}",
)
GENERIC = (
    r"(?i)^(?:fix|update|change|configure|debug|restart|retry)\s+(?:it|the issue|the code)\.?$",
    r"(?i)^(?:use|follow)\s+(?:the\s+)?(?:correct|right)\s+(?:version|configuration|setting)\.?$",
)
LOCAL = (rf"(?i){B}(?:this|our|my)\s+(?:repo(?:sitory)?|project|app|company|customer){B}", r"(?:^|\s)(?:\.\./|\./|src/|app/)[A-Za-z0-9_.@/-]+")


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def quality_signals(problem: Column, symptoms: Column, solution: Column, steps: Column, anchors: Column, applies: Column, checks: Column, evidence: Column, combined: Column) -> dict[str, Column]:
    """The eight signals; symptoms, steps, anchors and checks are counts."""
    return {
        "specific_problem": (word_count(problem) >= 6) & (symptoms > 0),
        "reusable_solution": (word_count(solution) >= 6) & (steps > 0) & ~_any(solution, GENERIC),
        "technical_anchor": anchors > 0,
        "applicability": F.coalesce(word_count(applies) >= 3, F.lit(False)) & applies.isNotNull(),
        "verification": (checks > 0) & (word_count(evidence) >= 3),
        "stands_alone": ~_any(combined, LOCAL),
        "trivial_or_local": _any(combined, TRIVIAL),
        "risky": _any(combined, RISKY),
    }


def quality_decision(s: dict[str, Column]) -> Column:
    rejected = ~s["specific_problem"] | ~s["reusable_solution"] | ~s["technical_anchor"] | ~s["stands_alone"] | s["trivial_or_local"]
    review = ~s["applicability"] | ~s["verification"] | s["risky"]
    return F.when(rejected, "rejected").when(review, "review").otherwise("eligible")


def route(relationship: Column) -> Column:
    return F.when(relationship == "novel", "discover_novel").when(relationship.isin("correction", "conflict"), "conflict_existing").otherwise("support_existing")


def is_alternative(relationship: Column) -> Column:
    return (route(relationship) == "support_existing") & (relationship == "variant")


def gate(decision: Column) -> Column:
    """The stage after the quality gate."""
    return F.when(decision == "rejected", "quality_blocked").otherwise("quality_assessed")


def moderation(action: Column, expected: Column, current: Column, has_candidate: Column, quality: Column) -> Column:
    """The moderation state after an action; the current one stays unless the action is allowed."""
    free = expected == current
    ok = (action != "approve") | (has_candidate & (F.coalesce(quality, F.lit("rejected")) != "rejected"))
    to = F.when(action.isin("approve", "restore"), "approved").when(action == "reject", "rejected").when(action == "flag", "flagged")
    return F.when(free & ok, F.coalesce(to, current)).otherwise(current)


def extraction_class(valid: Column, status: Column, complete: Column) -> Column:
    """quarantined unless valid; a reusable result must be complete."""
    return F.when(~valid, "quarantined").when((status == "reusable") & ~complete, "insufficient").otherwise(status)

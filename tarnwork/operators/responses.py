"""Model responses: decoded JSON, its issues against a schema, and its references held against the stored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.json_schema import ISSUES, MOST_ISSUES, Listed, Record, Text, issues, trimmed

#: The format of an extraction response.
_NAME, _PROSE, _IDS = Text(256), Text(10_000), Listed(Text(pattern=r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), 32, 1)
_SUPPORT = Record(
    {"sourceItemId": _IDS.item, "relationship": Text(choices=("supports_problem", "supports_solution", "verifies_outcome", "conflicts", "context")), "excerpt": _PROSE, "locator": Text(1_000)},
    frozenset({"locator"}),
)


def _filled(name: str):
    return lambda v: F.size(F.try_variant_get(v, f"$.{name}", "array<variant>")) > 0


def _reusable(*holds):
    """A rule for reusable responses only."""
    other = lambda v: F.try_variant_get(v, "$.classification", "string") != "reusable"
    said = lambda v: [h(v) if callable(h) else trimmed(F.try_variant_get(v, f"$.{h}", "string")) != "" for h in holds]

    def rule(v: Column) -> Column:
        every = F.lit(True)
        for h in said(v):
            every = every & F.coalesce(h, F.lit(False))
        return other(v) | every

    return rule


EXTRACTION = Record(
    {
        "classification": Text(choices=("reusable", "irrelevant", "insufficient_evidence", "conflicting_evidence")),
        "conciseReason": Text(2_000),
        "problemStatement": Text(10_000, blank=True),
        "ecosystems": Listed(_NAME, 16),
        "packages": Listed(Record({"ecosystem": _NAME, "name": _NAME, "version": _NAME, "role": Text(choices=("affected", "solution", "environment", "unknown"))}, frozenset({"version"})), 64),
        "platforms": Listed(_NAME, 32),
        "versions": Listed(_NAME, 64),
        "symptoms": Listed(Record({"summary": _PROSE, "errorMessage": Text(20_000), "evidenceSourceItemIds": _IDS}, frozenset({"errorMessage"})), 64),
        "rootCause": Record({"summary": _PROSE, "evidenceSourceItemIds": _IDS}),
        "attemptedApproaches": Listed(Record({"summary": _PROSE, "outcome": Text(choices=("failed", "partial", "unknown")), "reason": _PROSE, "evidenceSourceItemIds": _IDS}, frozenset({"reason"})), 32),
        "solutionSummary": Text(10_000, blank=True),
        "solutionSteps": Listed(
            Record({"instruction": _PROSE, "title": _NAME, "code": Text(50_000, 0, trim=False), "language": _NAME, "verification": _PROSE, "evidenceSourceItemIds": _IDS}, frozenset({"title", "code", "language", "verification"})), 64
        ),
        "caveats": Listed(_PROSE, 64),
        "evidence": Listed(_SUPPORT, 128),
        "conflicts": Listed(_SUPPORT, 64),
        "verificationLabels": Listed(Record({"label": Text(choices=("author_confirmed", "maintainer_confirmed", "official_doc_supported")), "evidenceSourceItemIds": _IDS}), 32),
    },
    frozenset({"problemStatement", "ecosystems", "packages", "platforms", "versions", "symptoms", "rootCause", "attemptedApproaches", "solutionSummary", "solutionSteps", "caveats", "evidence", "conflicts", "verificationLabels"}),
    (
        (_reusable("problemStatement"), "reusable_without_problem"),
        (_reusable("solutionSummary", _filled("solutionSteps")), "reusable_without_solution"),
        (_reusable(_filled("symptoms"), _filled("evidence")), "reusable_without_evidence"),
    ),
)
EXCERPTED, NESTED = ("evidence", "conflicts"), ("symptoms", "attemptedApproaches", "solutionSteps", "verificationLabels")


def references(v: Column, excerpted: tuple[str, ...] = EXCERPTED, nested: tuple[str, ...] = NESTED, single: tuple[str, ...] = ("rootCause",)) -> Column:
    """array<struct<ref, excerpt>> of what a response refers to; only references of ``excerpted`` lists have an excerpt."""
    get = lambda path, shape: F.coalesce(F.try_variant_get(v, path, shape), F.array().cast(shape))
    quoted = [F.transform(get(f"$.{n}", "array<struct<sourceItemId:string,excerpt:string>>"), lambda x: F.struct(x["sourceItemId"].alias("ref"), trimmed(x["excerpt"]).alias("excerpt"))) for n in excerpted]
    inner = [F.flatten(F.transform(get(f"$.{n}", "array<struct<evidenceSourceItemIds:array<string>>>"), lambda x: x["evidenceSourceItemIds"])) for n in nested]
    inner += [get(f"$.{n}.evidenceSourceItemIds", "array<string>") for n in single]
    bare = [F.transform(ids, lambda i: F.struct(i.alias("ref"), F.lit(None).cast("string").alias("excerpt"))) for ids in inner]
    return F.concat(*quoted, *bare)


def decoded(responses: DataFrame, items: DataFrame, response_id: str, body: str, item_id: str, text: str, schema: Record = EXTRACTION, refs=references) -> DataFrame:
    """(response_id, value variant, issues) of each response; ``value`` is null where there is any issue.

    No JSON (null and repeated keys included) is the issue ``invalid_json``; else issues of the schema; where there are
    none, those of its references: first items that do not exist (``unknown_reference``), then excerpts that their item
    does not hold (``excerpt_mismatch``), with the item as path. At most MOST_ISSUES each. Ids of both tables are unique;
    items with a null text exist and hold no excerpt. References meet the items in a join by id. Those of one response
    come together again, which the schema's limits bound.
    """
    read = responses.select(F.col(response_id).alias("__r"), F.try_parse_json(body).alias("__v")).withColumn("__i", issues(F.col("__v"), schema))
    asked = read.where(F.size("__i") == 0).select("__r", F.posexplode(refs(F.col("__v"))).alias("__at", "__ref"))
    held = items.select(F.col(item_id).cast("string").alias("__item"), F.col(text).alias("__text"))
    met = asked.join(held, F.col("__ref.ref") == F.col("__item"), "left")
    wrong = F.when(F.col("__item").isNull(), "unknown_reference").when(F.col("__ref.excerpt").isNotNull() & ~F.coalesce(F.contains("__text", "__ref.excerpt"), F.lit(False)), "excerpt_mismatch")
    bad = met.select("__r", F.struct((wrong == "excerpt_mismatch").alias("late"), F.col("__at").alias("at"), F.col("__ref.ref").alias("path"), wrong.alias("problem")).alias("x")).where("x.problem is not null")
    listed = F.slice(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["path"].alias("path"), x["problem"].alias("problem"))), 1, MOST_ISSUES)
    found = read.join(bad.groupBy("__r").agg(listed.cast(ISSUES).alias("__e")), "__r", "left")
    every = F.concat("__i", F.coalesce("__e", F.array().cast(ISSUES)))
    return found.select(F.col("__r").alias(response_id), F.when(F.size(every) == 0, F.col("__v")).alias("value"), every.alias("issues"))

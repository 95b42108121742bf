import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnwork.functions.json_schema import Listed, Text
from tarnwork.operators.responses import EXTRACTION, decoded

UUIDS = [f"{i:08d}-0000-4000-8000-000000000000" for i in range(6)]


def plain_issues(node, v, path=""):
    """The rules again, over Python values."""
    at = lambda n: f"{path}.{n}" if path else str(n)
    if isinstance(node, Text):
        if not isinstance(v, str):
            return [(path, "type")]
        t = v.strip() if node.trim else v
        if node.blank and not v.strip():
            return []
        if node.choices:
            return [] if v in node.choices else [(path, "choice")]
        if node.pattern and not re.search(node.pattern.replace("(?i)", ""), v.lower()):
            return [(path, "format")]
        return [(path, "short")] if len(t) < node.least else [(path, "long")] if node.most and len(t) > node.most else []
    if isinstance(node, Listed):
        if not isinstance(v, list):
            return [(path, "type")]
        out = [x for i, e in enumerate(v) for x in plain_issues(node.item, e, at(i))]
        return out + ([(path, "short")] if len(v) < node.least else [(path, "long")] if len(v) > node.most else [])
    if not isinstance(v, dict):
        return [(path, "type")]
    out = []
    for n, child in node.fields.items():
        out += plain_issues(child, v[n], at(n)) if n in v else [] if n in node.optional else [(at(n), "required")]
    out += [(path, "unknown_key")] if set(v) - set(node.fields) else []
    if not out and node.rules and v["classification"] == "reusable":
        has = lambda n: bool(v.get(n, "").strip() if isinstance(v.get(n, ""), str) else v[n])
        out += [] if has("problemStatement") else [("", "reusable_without_problem")]
        out += [] if has("solutionSummary") and has("solutionSteps") else [("", "reusable_without_solution")]
        out += [] if has("symptoms") and has("evidence") else [("", "reusable_without_evidence")]
    return out


def plain(body, items):
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    try:
        v = json.loads(body, object_pairs_hook=once)
    except (TypeError, ValueError):
        return [("", "invalid_json")]
    found = plain_issues(EXTRACTION, v)
    if found:
        return found[:32]
    quoted = [*v.get("evidence", []), *v.get("conflicts", [])]
    ids = [q["sourceItemId"] for q in quoted] + [i for n in ("symptoms", "attemptedApproaches", "solutionSteps", "verificationLabels") for x in v.get(n, []) for i in x["evidenceSourceItemIds"]]
    ids += v.get("rootCause", {}).get("evidenceSourceItemIds", [])
    out = [(i, "unknown_reference") for i in ids if i not in items]
    return (out + [(q["sourceItemId"], "excerpt_mismatch") for q in quoted if q["sourceItemId"] in items and q["excerpt"].strip() not in (items[q["sourceItemId"]] or "\0")])[:32]


def whole(rng):
    ids = lambda: [rng.choice(UUIDS[: 5 if rng.random() < 0.9 else 6])]
    quote = lambda: {"sourceItemId": ids()[0], "relationship": "context", "excerpt": rng.choice([" first words ", "second", "first words" if rng.random() < 0.9 else "absent"])}
    return {
        "classification": rng.choice(["reusable", "irrelevant"]), "conciseReason": "why", "problemStatement": rng.choice(["p", " ", "p"]), "solutionSummary": "s",
        "packages": [{"ecosystem": "npm", "name": "a", "role": "unknown"}], "symptoms": [{"summary": "é" * 10, "evidenceSourceItemIds": ids()}],
        "solutionSteps": [{"instruction": "do", "code": "", "evidenceSourceItemIds": ids()} for _ in range(rng.randrange(3))],
        "rootCause": {"summary": "r", "evidenceSourceItemIds": ids()}, "evidence": [quote() for _ in range(rng.randrange(4))], "conflicts": [],
    }


def spoiled(rng, v):
    """A value of ``v`` at a random place replaced, removed or added."""
    here = v
    while True:
        places = list(here) if isinstance(here, dict) else list(range(len(here)))
        if not places:
            return v
        k = rng.choice(places)
        if isinstance(here[k], (dict, list)) and here[k] and rng.random() < 0.7:
            here = here[k]
            continue
        if isinstance(here, dict) and rng.random() < 0.4:
            here.pop(k) if rng.random() < 0.6 else here.update({"extra": 1})
        else:
            here[k] = rng.choice([None, 3, 1.5, True, "", "  ", "x" * 300, "y" * 10_001, [], {}, [None], ["z"] * 70, {"q": 1}])
        return v


def test_equal_to_plain_rules(spark):
    rng = random.Random(9)
    items = {UUIDS[0]: "the first words and the second", UUIDS[1]: "first words second", UUIDS[2]: "second, then first words", UUIDS[3]: None, UUIDS[4]: ""}
    bodies = [whole(rng) for _ in range(60)]
    for _ in range(140):
        v = whole(rng)
        for _ in range(rng.randrange(1, 4)):
            v = spoiled(rng, v)
        bodies.append(v)
    texts = [json.dumps(b) for b in bodies] + [None, "", "nope", "[1]", "null", '"s"', "{}", "{", '{"a": 1, "a": 2}', json.dumps(whole(rng) | {"caveats": [7] * 64})]
    r = spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumn("text", F.lit("clash"))
    i = spark.createDataFrame(list(items.items()), "item string, text string").withColumn("id", F.lit(0))
    got = {x["id"]: x for x in decoded(r, i, "id", "body", "item", "text").select("id", "issues", F.col("value").isNotNull().alias("kept")).collect()}
    assert len(got) == len(texts)
    for n, body in enumerate(texts):
        want = plain(body, items)
        assert [(x["path"], x["problem"]) for x in got[n]["issues"]] == want, body
        assert got[n]["kept"] == (not want)
    problems = {x["problem"] for g in got.values() for x in g["issues"]}
    assert problems >= {"invalid_json", "type", "required", "choice", "format", "long", "short", "unknown_key", "unknown_reference", "excerpt_mismatch", "reusable_without_problem", "reusable_without_solution"}


@pytest.mark.parametrize("side", ["responses", "items"])
def test_empty_tables(spark, side):
    r = spark.createDataFrame([(1, "{}")], "id long, body string").limit(0 if side == "responses" else 1)
    i = spark.createDataFrame([], "item string, text string")
    assert decoded(r, i, "id", "body", "item", "text").count() == (side == "items")

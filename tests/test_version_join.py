import random

from pyspark.sql import functions as F

from tarnwork.functions import versions
from tarnwork.operators.version_join import fitting_sets, fitting_values, set_key

ODD = ["", "*", "x", ">2 <1", "1.2.3-alpha.1", ">=1.2.3-alpha <1.2.4", "<1.2.3-beta.2", "1.2.3 - 2.0", "v1.2.3", "V1.2.3", "^0.2.1", "^0.0.3", "~1.2", "SDK 54", "sdk 54", "54", "54.1.x || ^2", ">1.2.3", "<=1.2.3", "<1.2.3", "abc", "node 5", "=  1.2.3", "1.2.3+build", "999999999999.0.0", ">=1000"]


def made(rng):
    n = lambda: f"{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(4)}"
    return rng.choice([n(), f"^{n()}", f"~{n()}", f">={n()} <{n()}", f">{n()}", f"<={n()} || >{n()}", f"{rng.randrange(5)}.x", f"{n()}-rc.{rng.randrange(3)}", f"sdk {rng.randrange(4)}", f">{n()}-rc.1 <={n()}", "other"])


def test_values_equal_to_all_comparisons(spark):
    rng = random.Random(5)
    sides = [sorted({*ODD, *(made(rng) for _ in range(120))}) for _ in range(2)]
    rows = [spark.createDataFrame([(s, v, "clash") for s in ("Node", "deno") for v in side] + [(None, "1", ""), ("node", None, "")], "subject string, value string, place string") for side in sides]
    got = [tuple(r) for r in fitting_values(*rows).collect()]
    want = {(s, a, b, fit) for s in ("node", "deno") for a in sides[0] for b in sides[1] if (fit := versions.compare(a, b)) in ("exact", "compatible")}
    assert len(got) == len(set(got)) and set(got) == want


def test_lists_equal_to_the_pairwise_rule_with_hot_lists(spark):
    rng = random.Random(6)
    hot = [("NODE", "^1.2.0"), ("node", "sdk 3")]
    lists = lambda n: [hot if rng.random() < 0.3 else [(rng.choice(["node", "Node", "deno", "bun"]), made(rng)) for _ in range(rng.randrange(4))] for _ in range(n)]
    sides = lists(40), lists(60)
    frames = [spark.createDataFrame([(i, v) for i, v in enumerate(side)] + [(-1, None)], "id long, entries array<struct<subject:string,value:string>>") for side in sides]
    fits = fitting_sets(*frames, "entries")
    keyed = [f.select(F.col("id").alias(n), set_key(F.col("entries")).alias(f"{n}_set")) for f, n in zip(frames, ("asked", "stored"))]
    got = {(r["asked"], r["stored"], r["fit"]) for r in fits.join(keyed[0], "asked_set").join(keyed[1], "stored_set").collect()}
    assert got == {(i, j, f) for i, a in enumerate(sides[0]) for j, s in enumerate(sides[1]) if (f := versions.fit(a, s)) in ("exact", "compatible")}
    assert fits.count() == fits.select("asked_set", "stored_set").distinct().count()


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "subject string, value string")
    some = spark.createDataFrame([("node", "1.x")], "subject string, value string")
    assert fitting_values(none, some).count() == fitting_values(some, none).count() == fitting_values(none, none).count() == 0
    assert fitting_values(some, some).first()["fit"] == "exact"

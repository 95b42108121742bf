import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators.embedding_budget import planned_calls
from tarnwork.plans.ranges import ranked


def in_one_pass(rows, stored, calls):
    made, out = {}, {}
    for i, digest, public in sorted(rows):
        if digest is None:
            out[i] = "no_input"
        elif not public:
            out[i] = "forbidden"
        elif digest in stored:
            out[i] = "reused"
        elif digest in made:
            out[i] = "shared" if made[digest] <= calls else "exhausted"
        else:
            made[digest] = len(made) + 1
            out[i] = "computed" if made[digest] <= calls else "exhausted"
    return out


@pytest.mark.parametrize("calls", [0, 17, 10_000])
def test_equal_to_one_pass_with_a_hot_digest(spark, calls):
    rng = random.Random(calls)
    ids = rng.sample(range(10_000), 600)
    rows = [(i, None if rng.random() < 0.05 else "hot" if rng.random() < 0.4 else f"d{rng.randrange(120)}", rng.random() < 0.9) for i in ids]
    stored = {f"d{rng.randrange(120)}" for _ in range(30)}
    df = spark.createDataFrame(rows, "id long, digest string, public boolean").withColumn("call", F.lit("clash")).repartition(7)
    got = planned_calls(df, spark.createDataFrame([(s,) for s in [*stored, None]], "digest string"), "digest", "id", calls, F.col("public"))
    assert {r["id"]: r["state"] for r in got.collect()} == in_one_pass(rows, stored, calls)
    assert got.where("state = 'computed'").count() == min(calls, got.where("state in ('computed', 'shared', 'exhausted')").select("digest").distinct().count())


def test_empty_inputs_and_ranks_over_all_rows(spark):
    none = spark.createDataFrame([], "id long, digest string")
    assert planned_calls(none, none.select("digest"), "digest", "id", 5).count() == 0
    got = ranked(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(9), ["v"], "place").collect()
    assert all(r["place"] == r["v"] + 1 for r in got) and len(got) == 1000

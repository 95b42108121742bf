"""The text channel for one batch, and which queries a channel answers."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import search
from tarnwork.plans import catalog
from tarnwork.plans.shared import shared_dir

SF = "/root/testdata/sf0.001"


def test_best_rows_over_many_batches(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(700)]
    asked = [(q, " ".join(rng.sample(words, 4))) for q in range(9)] + [(9, None), (10, "none of them")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    want = []
    for qid, t in asked:
        found = [(-3.0 * sum(x.split().count(w) for w in set((t or "").split())), i) for i, x in docs]
        want += [(qid, i, -s) for s, i in sorted(f for f in found if f[0])[:25]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert sorted(map(tuple, search.lexical(q, d.repartition(2), {"text": 3}, 25).collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0] for r in search.answered_lexically(q, d, ["text"]).collect()} == set(range(9))


def test_answered_exactly(spark):
    d = spark.createDataFrame([(1, ["e1"], "npm"), (2, None, "pypi")], "doc_id long, codes array<string>, ecosystem string")
    q = spark.createDataFrame([(1, ["e1"], "go"), (2, ["e2"], "pypi"), (3, ["npm"], "go"), (4, None, None)], "query_id long, codes array<string>, ecosystem string")
    assert {r[0] for r in search.answered_exactly(q, d).collect()} == {1, 2} == {r[0] for r in search.exact(q, d, 5).select("query_id").collect()}


@pytest.mark.parametrize("name", ["H2_lexical_channel", "H3_lexical_five_fields", "J12_channel_merge", "H6_capabilities", "O1_and_O2_scope_merge"])
def test_one_batch_builds_no_index(spark, name):
    catalog.load()
    before = set(glob.glob(f"{shared_dir(spark)}/terms-*"))
    assert catalog.QUERIES[name](spark, SF).agg(F.count("*")).first()[0] > 0
    assert set(glob.glob(f"{shared_dir(spark)}/terms-*")) == before

"""Pairs found and compared block against block."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import text as text_functions
from tarnwork.operators import canonical, profile_blocks
from tarnwork.operators.profile_blocks import meeting
from tarnwork.plans import catalog
from tarnwork.plans.shared import shared_dir

SF = "/root/testdata/sf0.001"


def test_common_values_against_brute_force(spark):
    rng = random.Random(3)
    sets = lambda n, top: sorted(rng.sample(range(top), rng.randrange(n)))
    rows = [(i, sets(4, 40) + [99] * (i % 3 == 0), None if i % 11 == 0 else sets(30, 60), None if i % 7 == 0 else i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, keys array<long>, words array<long>, kind long")
    want = {}
    for i, ki, wi, ei in rows:
        for j, kj, wj, ej in rows[i + 1 :]:
            if set(ki) & set(kj):
                sizes = [None if w is None else len(w) for w in (wi, wj)]
                want[i, j] = (len(set(wi or []) & set(wj or [])), sorted(sizes, key=str), None if None in (ei, ej) else ei == ej)
    for block in (None, 1000, 17):
        found = meeting(df, ("words",), ("kind",), block).collect()
        assert {(r["left_id"], r["right_id"]): (r["words_both"], sorted([r["words_left"], r["words_right"]], key=str), r["kind"]) for r in found} == want
        assert len(found) == len(want)
    assert meeting(df.limit(0), ("words",)).count() == 0


def _profiles(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["build", "plugin", "cache", "fails", "proxy", "token", "file"]) for _ in range(n))
    rows = []
    for i in range(80):
        if i % 4 and rows:
            p, s, e = rows[rng.randrange(len(rows))][1:4]
            s = s + " again" if i % 4 == 1 else s
            e = rng.choice([e, "", "cannot read x 1.2"])
        else:
            p, s, e = text(6), text(20), rng.choice(["cannot find y", ""])
        rows.append((i, p, s, e))
    base = spark.createDataFrame(rows, "candidate_id long, problem string, solution string, error string")
    return canonical.profiles(base.select("*", F.lit("npm").alias("ecosystem"), F.array(F.lit("a")).alias("packages"), F.array(F.lit("linux")).alias("platforms")))


def test_blocked_comparisons_are_those_of_all_pairs(spark):
    """And no pair is shuffled: nothing is dealt out again after the blocks have met."""
    found = _profiles(spark).cache()
    own = canonical.slim(found)
    got = canonical.blocked_comparisons(own, block=13)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    pairs = found.select("candidate_id", F.explode("keys").alias("key"))
    pairs = pairs.alias("a").join(pairs.alias("b"), "key").where("a.candidate_id < b.candidate_id").select(F.col("a.candidate_id").alias("left_id"), F.col("b.candidate_id").alias("right_id")).distinct().cache()
    want = canonical.compared(pairs, found)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    c = F.col
    merged = want.where(canonical.decision(c("hard"), c("same"), c("same_error"), c("errors"), c("packages"), c("problem"), c("solution")) == "auto_merge")
    first = {r["right_id"]: r["into"] for r in merged.groupBy("right_id").agg(F.min("left_id").alias("into")).collect()}
    assert len(first) > 20
    assert {r["candidate_id"]: r["into"] for r in canonical.first_merges(own, block=13).collect()} == first


def test_digests_of_profiles_write_nothing(spark):
    catalog.load()
    before = set(glob.glob(f"{shared_dir(spark)}/*"))
    assert catalog.QUERIES["R9_similarity_profiles"](spark, SF).count()
    assert set(glob.glob(f"{shared_dir(spark)}/*")) == before


def _shared_keys(rows):
    """(id, keys, words, kind, part) -> {pair: common words}."""
    return {(a[0], b[0]): len(set(a[2]) & set(b[2])) for a in rows for b in rows if a[0] < b[0] and set(a[1]) & set(b[1])}


def test_blocks_are_stored_once_and_never_shuffled(spark):
    """However many blocks there are, what is stored hardly grows, and nothing is dealt out by block."""
    rng = random.Random(7)
    rows = [(i, [i % 40, 100 + i % 7], [rng.getrandbits(60) for _ in range(200)] + list(range(i % 5)), i % 2, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, keys array<long>, words array<long>, kind long, part long")
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{shared_dir(spark)}/**/*.parquet", recursive=True))
    before = size()
    got = meeting(df, ("words",), ("kind",), block=20)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["left_id"], r["right_id"]): r["words_both"] for r in got.collect()} == _shared_keys(rows)
    assert size() - before < 2 * 400 * 200 * 8


def test_groups_that_share_no_key_need_not_meet(spark, monkeypatch):
    """Large and small groups, rows without a group that share keys with all of them, values that nearly all rows have, and blocks cut by their items."""
    monkeypatch.setattr(profile_blocks, "BLOCK_ITEMS", 3_000)
    rng = random.Random(11)
    rows = []
    for i in range(300):
        part = None if i % 29 == 0 else (i if i < 40 else i % 3)
        keys = [rng.randrange(12) for _ in range(2)] if part is None else [1_000 * (part + 1) + rng.randrange(12) for _ in range(2)]
        words = [v for v in range(60) if rng.random() < (0.8 if v < 30 else 0.02)] + [10_000 + i]
        rows.append((i, sorted({*keys, *([7] if part is None else [1_007, 5] if part == 0 else [])}), words, i % 2, part))
    rows = [(i, k if p is not None else k + [1_007], w, e, p) for i, k, w, e, p in rows]
    df = spark.createDataFrame(rows, "id long, keys array<long>, words array<long>, kind long, part long")
    for block in (None, 37):
        found = meeting(df, ("words",), ("kind",), block, "part").collect()
        assert {(r["left_id"], r["right_id"]): r["words_both"] for r in found} == _shared_keys(rows)
        assert len(found) == len(_shared_keys(rows))


@pytest.mark.parametrize("name", ["R10_pair_comparison", "R11_pair_decisions"])
def test_queries_store_profiles_once(spark, name):
    catalog.load()
    before = set(glob.glob(f"{shared_dir(spark)}/*"))
    got = catalog.QUERIES[name](spark, SF)
    assert [os.path.basename(f).rsplit("-", 1)[0] for f in set(glob.glob(f"{shared_dir(spark)}/*")) - before] == ["profile-blocks"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_split_as_by_ranges(spark):
    every = spark.createDataFrame([("".join(f"a{chr(c)}b " for c in range(1, 0x500) if not 0xD800 <= c < 0xE000),)], "t string")
    by_ranges, by_table = every.select(F.split("t", r"[^a-z0-9_@./<>:-]+"), F.split("t", text_functions.BETWEEN_TOKENS)).first()
    assert by_table == by_ranges
    assert "-z" not in text_functions.BETWEEN_TOKENS  # a range would be tested character by character

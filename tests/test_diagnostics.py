import random

from pyspark.sql import functions as F

from tarnwork.operators.diagnostics import embedded
from tarnwork.operators.search import embedded_diagnostic, trimmed_diagnostic


def frames(spark, texts, stored):
    return spark.createDataFrame(texts, "id long, body string").withColumn("key", F.lit("clash")), spark.createDataFrame(stored, "n long, diagnostic string")


def pairwise(texts, stored):
    every = texts.crossJoin(stored.select("diagnostic").distinct())
    return {(r[0], r[1]) for r in every.where(embedded_diagnostic(F.col("body"), F.col("diagnostic"))).select("id", trimmed_diagnostic(F.col("diagnostic"))).collect()}


def test_equal_to_every_pair(spark):
    rng = random.Random(3)
    words = ["error", "cannot", "read", "'name'", "of", "undefined", "err_a_b", "x$", "$x", "été", "failed", "<path>", "ts2339:", "it`s", "a.b", "(", "\\e", "^[a"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    stored = [(i, line(rng.randrange(3, 9)) + rng.choice(["", ".", "!;"])) for i in range(150)]
    stored += [(900, "'''''''''''''''''''''error"), (901, "error:'" + "-" * 30), (902, "short 'error'"), (903, None), (904, ""), (905, "no failure is named 'here' at all"), (906, stored[0][1])]
    texts = [(i, rng.choice(["", "_", " ", "."]).join([line(rng.randrange(30)), rng.choice(stored[:155])[1] or "", line(5)])) for i in range(500)]
    texts += [(800, None), (801, ""), (802, "!!!"), (803, "word " * 50_000 + stored[0][1]), (804, "x'''''''''''''''''''''error"), (805, "'''''''''''''''''''''error"), (806, "'''''''''''''''''''''errors")]
    t, s = frames(spark, texts, stored)
    got = [tuple(r) for r in embedded(t, s, "id", "body", "diagnostic").collect()]
    assert len(got) == len(set(got)) and set(got) == pairwise(t, s) and len(got) > 100


def test_hot_diagnostic_and_empty_tables(spark):
    hot = "type error ts2339: property 'source' does not exist"
    t, s = frames(spark, [(i, f"why {hot} here {i}" if i % 3 else f"{i} fine") for i in range(600)], [(i, hot + ".") for i in range(200)])
    assert embedded(t, s, "id", "body", "diagnostic").count() == 400
    assert embedded(t.limit(0), s, "id", "body", "diagnostic").count() == embedded(t, s.limit(0), "id", "body", "diagnostic").count() == 0


def test_long_diagnostics(spark):
    rng = random.Random(5)
    words = ["error", "cannot", "read", "'name'", "of", "failed"]
    line = lambda n: "error 'x' " + " ".join(rng.choice(words) for _ in range(n))
    stored = [(i, line(n)) for i, n in enumerate([12, 13, 14, 15, 16, 17, 30, 60] * 4)]
    texts = [(i, " ".join([line(3), d, line(i % 4)])) for i, d in stored] + [(900 + i, d.rsplit(" ", 1)[0]) for i, d in stored]
    t, s = frames(spark, texts, stored)
    got = {tuple(r) for r in embedded(t, s, "id", "body", "diagnostic").collect()}
    assert got == pairwise(t, s) and len(got) >= 30


def test_lookups_do_not_grow_with_shared_words(spark, monkeypatch):
    """Every two neighbouring words are frequent, whole diagnostics are not: what is looked up is what is there."""
    from tarnwork.operators import diagnostics

    counts, write = {}, diagnostics.written
    monkeypatch.setattr(diagnostics, "written", lambda df, tag: counts.update({tag: (out := write(df, tag)).count()}) or out)
    lines = [f"error 'k': {a} value {b}.{c} seen" for a in range(8) for b in range(8) for c in range(8)]
    t, s = frames(spark, list(enumerate(lines)), list(enumerate(lines)))
    assert embedded(t, s, "id", "body", "diagnostic").count() == len(lines) == counts["diagnostic-hits"]

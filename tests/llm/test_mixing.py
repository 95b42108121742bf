import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import mixing


def test_rates_against_numpy(spark):
    rng = np.random.default_rng(15)
    p = rng.dirichlet([0.3, 0.5, 0.3], 300)
    tokens = rng.integers(0, 900, 300)
    rows = spark.createDataFrame([(i, [float(x) for x in q], int(t)) for i, (q, t) in enumerate(zip(p, tokens))], "doc_id long, p array<double>, tokens long")
    targets = (0.6, 0.3, 0.1)
    rated, fit = mixing.fit_rates(rows, targets)
    rate = {r["doc_id"]: r["rate"] for r in rated.collect()}
    assert min(rate.values()) >= 0
    r = np.array([rate[i] for i in range(300)])
    totals = (r * tokens) @ p
    assert np.allclose(totals, fit.have, rtol=1e-6) and fit.reached
    assert np.allclose(fit.want, np.array(targets) * tokens.sum())
    assert np.abs(totals / tokens.sum() - np.array(targets)).max() < 1e-3
    # the same steps in numpy
    t = tokens / tokens.sum()
    gram = (p * t[:, None]).T @ p
    solve = np.linalg.pinv(gram + 1e-6 * np.eye(3))
    mine = np.ones(300)
    for _ in range(mixing.ROUNDS):
        miss = np.array(targets) - (mine * t) @ p
        if np.abs(miss).max() <= mixing.CLOSE:
            break
        mine = np.maximum(0, mine + p @ (mixing.STEP * solve @ miss))
    assert np.allclose(mine, r, atol=1e-9)


def labelled(spark):
    rng = random.Random(16)
    words = {0: ["junk", "spam", "zzz"], 1: ["fine", "prose", "well"], 2: ["awful", "nasty", "vile"]}
    docs, labels = [], []
    for i in range(300):
        d = rng.choice([0, 1, 1, 2])
        docs.append((i, " ".join(rng.choice(words[d] + ["the", "of"]) for _ in range(rng.randint(5, 60))), f"s{i}"))
        if i % 2:
            labels.append((i, int(d == 1), int(d == 2)))
    docs += [(1000, None, "n"), (1001, "", "e"), (1, docs[1][1], "again")]
    return spark.createDataFrame(docs, "doc_id long, text string, p string"), spark.createDataFrame(labels + [(None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int"), docs


def test_posteriors_and_mix(spark):
    docs, labels, rows = labelled(spark)
    model = mixing.train(docs, labels)
    got = mixing.posteriors(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(abs(sum(r["p"]) - 1) < 1e-6 for r in got)
    toxic = [r for r in got if r["p"][2] > 0.5]
    text = {i: t or "" for i, t, _ in rows}
    assert len(toxic) > 30 and all(any(w in text[r["doc_id"]] for w in ("awful", "nasty", "vile")) for r in toxic)
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    first = sorted((r["doc_id"], r["p"]) for r in out.collect())
    assert first == sorted((r["doc_id"], r["p"]) for r in mixing.mixed(docs, labels).collect())
    bad = [i for i, _ in first if any(w in text[i] for w in ("awful", "nasty", "vile"))]
    assert len(bad) < 0.6 * sum(any(w in t for w in ("awful", "nasty", "vile")) for t in text.values())


def test_edges(spark):
    docs, labels, _ = labelled(spark)
    assert mixing.train(docs, labels.limit(0)) is None
    assert mixing.mixed(docs, labels.limit(0)).count() > 0
    assert mixing.mixed(docs.limit(0), labels).count() == 0
    assert {r["domain"] for r in mixing.domain_of_labels(labels).collect()} == {0.0, 1.0, 2.0}


def test_unreached_targets_are_told(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 10), (2, [0.5, 0.5, 0.0], 10)], "doc_id long, p array<double>, tokens long")
    assert not mixing.fit_rates(rows, (0.2, 0.3, 0.5))[1].reached
    assert mixing.fit_rates(rows.limit(0))[1].reached


def test_held_out_posteriors_and_token_counts(spark):
    from tarnwork.llm.tokens import encoder, vocabulary_path

    docs, labels, rows = labelled(spark)
    encode = encoder(vocabulary_path())
    long = "fine prose well " * 60_000
    more = docs.unionByName(spark.createDataFrame([(2000, long, "l")], "doc_id long, text string, p string")).withColumn("tokens", F.lit("x")).withColumn("rate", F.lit(7))
    got = mixing.posteriors(more, mixing.train(more, labels), ["doc_id"]).collect()
    text = {i: t or "" for i, t, _ in rows} | {2000: long}
    assert all(r["tokens"] == len(encode(text[r["doc_id"]])) for r in got)
    words = {"junk": 0, "spam": 0, "zzz": 0, "fine": 1, "prose": 1, "well": 1, "awful": 2, "nasty": 2, "vile": 2}
    told = [(next((words[w] for w in text[r["doc_id"]].split() if w in words), None), int(np.argmax(r["p"]))) for r in got if r["doc_id"] % 2 == 0 and text[r["doc_id"]]]
    told = [x for x in told if x[0] is not None]
    assert len(told) > 100 and sum(a == b for a, b in told) >= 0.97 * len(told)
    out = mixing.mixed(more, labels)
    assert out.columns == more.columns and {r["tokens"] for r in out.collect()} == {"x"}


def test_mixed_tells_unreached_targets(spark):
    docs = spark.createDataFrame([(i, f"plain words {i}") for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="not reached"):
        assert mixing.mixed(docs, none, (0.9, 0.1, 0.0)).columns == docs.columns
    with pytest.raises(ValueError, match="not reached"):
        mixing.mixed(docs, none, (0.9, 0.1, 0.0), strict=True)


def test_fit_is_as_wide_as_its_sample(spark):
    docs, labels, _ = labelled(spark)
    fitted = []

    class Watched(mixing.LogisticRegression):
        def fit(self, rows):
            fitted.append({len(r["bag"]) for r in rows.collect()})
            return super().fit(rows)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "LogisticRegression", Watched)
        model = mixing.train(docs, labels)
    ids = {i for r in docs.join(labels.dropna(), "doc_id").where("text is not null").collect() for i in mixing.encoder(mixing.vocabulary_path())(r["text"])}
    assert fitted == [{len(ids)}] and len(ids) < 100
    assert model.weights.shape == (mixing.END_OF_TEXT + 1, 3) and set(np.flatnonzero(np.abs(model.weights).sum(1))) <= ids

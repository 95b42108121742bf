import math

import numpy as np

from tarnwork.llm import ivf_pq


def brute(ids, x, k, every):
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            score = (x * x[i]).sum(1)
            out[int(ids[i])] = [(int(ids[j]), score[j]) for j in sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-score[j], ids[j]))[:k]]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 1) for i, row in zip(ids, x)], "vec_id long, embedding array<float>, list int")


def test_recall_ties_and_scores(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(12, 18))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 18))).astype(np.float32)
    x[200:700] = x[3]  # one very common vector
    ids = np.arange(1500)
    old, ivf_pq.BLOCK_ROWS = ivf_pq.BLOCK_ROWS, 128
    try:
        got = {}
        for r in ivf_pq.nearest(frame(spark, ids, x)).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    finally:
        ivf_pq.BLOCK_ROWS = old
    want = brute(ids, x.astype(float), 20, 20)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(abs(s - float((x[v].astype(float) * x[q].astype(float)).sum())) < 1e-12 for _, v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    same = [v for _, v, _ in got[220]]  # a copy's nearest are other copies, smallest ids first, if nothing is nearer
    if want[220][0][0] == 3:
        assert same == [v for v, _ in want[220]]


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ivf_pq.nearest(df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ivf_pq.nearest(df.limit(0)).count() == 0
    assert ivf_pq.nearest(df.where("vec_id = 0")).count() == 0


def test_recall_of_many_rows_and_of_a_crowd(spark):
    rng = np.random.default_rng(21)
    x = (rng.normal(size=(60, 32))[rng.integers(0, 60, 24_000)] + 0.7 * rng.normal(size=(24_000, 32))).astype(np.float32)
    x[5000:11_000] = x[7] + 1e-3 * rng.normal(size=(6000, 32)).astype(np.float32)  # nearly equal, so with equal codes
    ids = np.arange(len(x))
    old, ivf_pq.QUERY_ROWS = ivf_pq.QUERY_ROWS, 200  # several sets for a list
    try:
        got = {}
        for r in ivf_pq.nearest(frame(spark, ids, x)).collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
    finally:
        ivf_pq.QUERY_ROWS = old
    d = x.astype(float)
    assert sorted(got) == list(range(0, len(x), 20))
    product = d[::20] @ d.T
    product[np.arange(len(product)), ids[::20]] = -np.inf
    best = np.argsort(-product, 1, kind="stable")[:, :20]
    recall = [len(set(b.tolist()) & set(got[q])) / 20 for q, b in zip(range(0, len(x), 20), best)]
    assert np.mean(recall) >= 0.9 and np.mean(recall[250:550]) >= 0.9

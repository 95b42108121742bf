import math

import numpy as np
import pytest

from tarnwork.llm import whitening as wh

SF = "/root/testdata/sf0.001"


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n = len(x)
    c = (n * x - x.sum(0)) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    return n, c, e[::-1], axes[:, ::-1]


def held_against(rows, vectors, ids, components):
    n, c, e, axes = brute(vectors)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * components
    for k in range(components):
        want = c @ axes[:, k] / math.sqrt(e[k])
        have = np.array([got[i, k + 1]["whitened"] for i in ids])
        assert np.allclose(have, want * np.sign(have @ want), atol=1e-7)
        assert math.isclose(got[ids[0], k + 1]["explained"], e[k] / e.sum(), rel_tol=1e-9)
    assert {r["n"] for r in rows} == {n}
    assert max(r["identity_error"] for r in rows) < 1e-8
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    total = x.sum(0)
    for i, row in zip(ids, x):
        assert got[i, 1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, total))


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(500, 12)) * np.logspace(0, -1.5, 12)).astype(np.float32).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(7)
    held_against(wh.whitened(rows).collect(), vectors, list(range(500)), 8)
    held_against(wh.whitened(rows, components=3).collect(), vectors, list(range(500)), 3)


def test_given_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = wh.clean_vectors(table).collect()
    held_against(wh.op11_whitening(spark, SF).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows], 8)


def test_ill_conditioned_and_dependent_columns(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 3))
    near = np.c_[base * [100, 1, 0.05], base[:, 0] * 100, np.full(400, 3.0)]  # a repeated and a constant column
    rows = spark.createDataFrame(list(enumerate(near.tolist())), "vec_id long, embedding array<double>")
    got = wh.whitened(rows).collect()
    held_against(got, near.tolist(), list(range(400)), 3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 4)).tolist()
    rows = [(i, v, "x", 1.0) for i, v in enumerate(good)]
    odd = [(100, None, "x", 1.0), (101, [1.0, None, 2.0, 3.0], "x", 1.0), (102, [nan, 1.0, 1.0, 1.0], "x", 1.0), (103, [inf, 1.0, 1.0, 1.0], "x", 1.0), (104, [], "x", 1.0), (105, [1.0, 2.0], "x", 1.0)]
    schema = "vec_id long, embedding array<double>, component string, whitened double"
    held_against(wh.whitened(spark.createDataFrame(rows + odd, schema)).collect(), good, list(range(40)), 4)
    again = wh.whitened(spark.createDataFrame(rows + rows[:5] + [(None, good[0], None, None)], schema))
    assert again.count() == 46 * 4 and again.where("vec_id is null").count() == 4
    assert again.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = spark.createDataFrame([(i, [1.0, 2.0], "", 0.0) for i in range(9)], schema)
    assert wh.whitened(same).count() == 0
    assert wh.whitened(spark.createDataFrame(odd[:1], schema)).count() == 0
    assert wh.whitened(spark.createDataFrame([], schema)).count() == 0


def test_deviation_beyond_a_long_is_an_error(spark):
    rows = spark.createDataFrame([(0, [3.0e9]), (1, [-3.0e9]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="range of a long"):
        wh.whitened(rows).collect()

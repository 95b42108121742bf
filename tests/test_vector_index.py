import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import search, vector_index

N, POOL = 4000, 20


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    v = centers[rng.integers(0, 30, N)] + 0.5 * rng.normal(size=(N, 16))
    v[: N // 3] = v[0] + 0.01 * rng.normal(size=(N // 3, 16))  # a third of all rows in one place
    rows = [(i, x.tolist(), ["active", "draft"][i % 10 == 0], i % 100) for i, x in enumerate(v)]
    rows += [(N, None, "active", 0), (N + 1, [0.0] * 16, "active", 0), (N + 2, [float("nan")] + [1.0] * 15, "active", 0)]
    return spark.createDataFrame(rows, "doc_id long, vector array<double>, status string, owner int").repartition(4).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where(f"doc_id % 80 = 7 and doc_id < {N}").select(F.col("doc_id").alias("query_id"), "vector")


def exhaustive(queries, rows, pool=POOL):
    q, r = queries.collect(), rows.where(f"doc_id < {N}").collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([x["doc_id"] for x in r])
    scores = np.round(unit([x["vector"] for x in q]) @ unit([x["vector"] for x in r]).T, 9)
    return {x["query_id"]: [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:pool]] for x, s in zip(q, scores)}


def recall(found, want):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    assert all(len(v) <= POOL for v in got.values())
    for q, rows in want.items():
        assert all(abs(got[q][d] - s) < 1e-8 for d, s in rows if d in got[q])  # what is found has the whole score
    # as good as the exhaustive one: ties are as good as each other
    hits = sum(sum(s >= rows[-1][1] - 1e-9 for s in got[q].values()) for q, rows in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_under_filters(spark, vectors, queries, tmp_path):
    index = vector_index.build(vectors, str(tmp_path / "index"), ("status", "owner"))
    assert index.rows(spark).count() == N
    for where in (None, F.col("status") == "draft", F.col("owner") == 7):
        rows = vectors if where is None else vectors.where(where)
        assert recall(vector_index.search(queries, index, POOL, where), exhaustive(queries, rows)) >= 0.9
    assert vector_index.search(queries, index, POOL, F.col("status") == "none").count() == 0


def test_only_probed_partitions_are_read(spark, vectors, queries, tmp_path, monkeypatch):
    index = vector_index.build(vectors, str(tmp_path / "index"), ("status", "owner"))
    found = vector_index.search(queries.limit(1), index, 5, F.col("status") == "active")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {f.split("list=")[1].split("/")[0] for f in index.rows(spark).inputFiles()}
    probed = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert probed.count(",") + 1 < len(files)
    assert "EqualTo(status,active)" in plan  # pushed to the reader


def test_changes_and_edges(spark, vectors, queries, tmp_path):
    index = vector_index.build(vectors, str(tmp_path / "index"), ("status", "owner"))
    moved = vectors.where("doc_id in (10, 11)").withColumn("vector", F.transform("vector", lambda c: -c)).unionByName(vectors.where("doc_id = 12").withColumn("vector", F.lit(None).cast("array<double>")))
    rows = vectors.join(moved.select("doc_id"), "doc_id", "left_anti").unionByName(moved.where("vector is not null"))
    index = vector_index.refreshed(index, moved)
    assert index.rows(spark).count() == N - 1
    assert recall(vector_index.search(queries, index, POOL), exhaustive(queries, rows)) >= 0.9
    empty = vector_index.build(vectors.limit(0), str(tmp_path / "empty"), ("status",))
    assert vector_index.search(queries, empty, POOL).count() == 0
    assert vector_index.search(queries.limit(0), index, POOL).count() == 0


def test_exhaustive_channel_keeps_the_best_of_a_task(vectors, queries):
    got = search.semantic(queries, vectors.where(f"doc_id < {N}"), POOL).collect()
    want = exhaustive(queries, vectors)
    assert {(r["query_id"], r["doc_id"]) for r in got} == {(q, d) for q, rows in want.items() for d, _ in rows}

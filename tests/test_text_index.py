import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import search, text_index

FIELDS = {"title": 10, "problem": 8, "text": 1}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(3000)]
    out = []
    for i in range(600):
        n = rng.choice((0, 3, 30, 30, 30, 300))
        out.append((i, " ".join(rng.sample(words, 3)), " ".join(rng.sample(words, 6)), " ".join(rng.choice(words) for _ in range(n)), ["active", "draft"][i % 10 == 0]))
    out += [(600, None, None, None, "active"), (601, "", "É é", "W1 w2-w3", None), (602, "w1", "", "w1 " * 50_000, "active")]
    return out + [(1000 + i, "same title", "w5 w6", "w5 w7 w8", "active") for i in range(300)]  # a third alike


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, problem string, text string, status string").repartition(3)


QUERIES = [(1, "W1 w2 w900 nowhere"), (2, "w5 w7"), (3, "w1 w1 w1"), (4, ""), (5, None), (6, "nowhere"), (7, " ".join(f"w{i}" for i in range(200))), (8, "same")]


def expected(rows, pool, fields=FIELDS):
    names = ("title", "problem", "text")
    of = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    weights = {}
    for i, *texts, _ in rows:
        total = Counter()
        for name, t in zip(names, texts):
            for term, n in Counter(of(t)).items():
                total[term] += fields.get(name, 0) * n
        weights[i] = total
    out = []
    for q, text in QUERIES:
        scores = {i: sum(w[t] for t in set(of(text))) for i, w in weights.items()}
        out += [(q, i, float(s)) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])) if s > 0][:pool]
    return sorted(out)


@pytest.mark.parametrize("pool, range_docs", [(5, 20), (50, 64), (2000, 8), (7, 5000)])
def test_equal_to_scoring_every_document(spark, docs, rows, tmp_path, pool, range_docs):
    index = text_index.build(docs, str(tmp_path / "index"), FIELDS, range_docs=range_docs)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    assert sorted(map(tuple, text_index.search(queries, index, pool).collect())) == expected(rows, pool)
    assert sorted(map(tuple, search.lexical(queries, docs, list(FIELDS), pool).collect())) == expected(rows, pool)


def test_ranges_are_bounded_and_alike(spark, docs, tmp_path):
    index = text_index.build(docs, str(tmp_path / "index"), FIELDS, range_docs=50)
    sizes = [r["count"] for r in index.documents(spark).groupBy("at").count().collect()]
    assert sum(sizes) == 903 and max(sizes) <= 100 and len(sizes) >= 12


def test_filters_and_edges(spark, docs, rows, tmp_path):
    index = text_index.build(docs, str(tmp_path / "index"), FIELDS, ("status",), 40)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = text_index.search(queries, index, 9, F.col("status") == "draft")
    assert sorted(map(tuple, got.collect())) == expected([r for r in rows if r[4] == "draft"], 9)
    assert text_index.search(queries, index, 9, F.col("status") == "none").count() == 0
    empty = text_index.build(docs.limit(0), str(tmp_path / "empty"), FIELDS)
    assert text_index.search(queries, empty, 9).count() == 0
    assert text_index.search(queries.where("query_id in (4, 5)"), index, 9).count() == 0


def test_only_asked_partitions_and_few_blocks_are_read(spark, docs, tmp_path, monkeypatch):
    index = text_index.build(docs, str(tmp_path / "index"), FIELDS, range_docs=20)
    kept, plans = {}, []
    monkeypatch.setattr(text_index, "written", lambda df, tag: kept.setdefault(tag, spark.createDataFrame(df.collect(), df.schema)) if plans.append(df._jdf.queryExecution().executedPlan().toString()) is None else None)
    found = text_index.search(spark.createDataFrame([(1, "w1 w2")], "query_id long, text string"), index, 3)
    plan = plans[0]
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term, [w1,w2])" in plan
    assert sorted(r["doc_id"] for r in found.collect())
    bar = min(r["score"] for r in kept["heads"].collect())
    bounds = kept["bounds"].collect()
    assert sum(r["first"] or r["bound"] >= bar for r in bounds) < len(bounds) / 2

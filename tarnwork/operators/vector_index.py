"""A stored vector index: an inverted file that is partitioned by list and searched under filters.

The index is two Parquet tables in one folder: ``lists`` (number and centroid) and ``rows`` (every vector with its id
and the columns that filters use), partitioned by list. A search first counts, from the filter columns alone, how many
rows of each list pass the filter. A query then probes its nearest lists until these hold a stated multiple of the
rows it wants, so a filter that few rows pass probes more lists and finds as much as one that all pass. Only the
probed partitions are read, and a row is scored only for the queries that probe its list, on its whole vector.

Centroids are fitted on a bounded sample, and so is the multiple: on the sample, searches are held against all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tarnwork.operators.search import best, collected
from tarnwork.plans.shared import written

#: Rows that the centroids are fitted on, about; vectors a list; lists at most, which every task holds.
SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 100, 4_096
#: Recall that the multiple is chosen for, on the sample, and the multiples that are tried.
RECALL, MULTIPLES = 0.97, (2, 3, 4, 6, 8, 12, 16, 24, 32, 64)
#: Rows wanted by a query when the multiple is chosen.
MEASURED_POOL, MEASURED_QUERIES = 50, 200
_ROUNDS = 12


@dataclass(frozen=True)
class VectorIndex:
    """A written index: its folder, the columns that filters can use, and how far a query reaches."""

    path: str
    filters: tuple[str, ...]
    multiple: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def centroids(self, spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and centroids of the lists, MOST_LISTS rows at most."""
        found = sorted(spark.read.parquet(f"{self.path}/lists").select("list", "centroid").collect())
        return np.array([r["list"] for r in found]), np.array([r["centroid"] for r in found])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids on the unit sphere, by spherical k-means from rows drawn with a fixed seed."""
    centroids = sample[np.random.default_rng(7).choice(len(sample), lists, replace=False)]
    for _ in range(_ROUNDS):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where((np.bincount(own, minlength=lists) > 0)[:, None], _unit(sums), centroids)
    return centroids


def _probed(near: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """Whether a query (row) probes a list: in order of nearness, until the lists before hold the wanted count."""
    order = np.argsort(-near, axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, order, before < wanted, axis=1)
    return out & (counts > 0)


def _multiple(sample: np.ndarray, centroids: np.ndarray) -> int:
    """The least multiple that reaches ``RECALL`` on the sample, for pools in proportion to it."""
    queries = sample[:: max(1, len(sample) // MEASURED_QUERIES)]
    pool = min(MEASURED_POOL, max(1, len(sample) // 20))
    own = (sample @ centroids.T).argmax(1)
    counts = np.bincount(own, minlength=len(centroids))
    score = queries @ sample.T
    bar = np.partition(score, -pool, axis=1)[:, -pool][:, None]
    for m in MULTIPLES:
        probed = _probed(queries @ centroids.T, counts, m * pool)
        if ((score >= bar) & probed[:, own]).sum() >= RECALL * (score >= bar).sum():
            return m
    return MULTIPLES[-1]


def _with_list(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("list", IntegerType())])


def build(vectors: DataFrame, path: str, filters: tuple[str, ...] = (), lists: int | None = None) -> VectorIndex:
    """Write the index of ``vectors`` (doc_id, vector, the columns of ``filters``) to ``path``, in place of one there.

    Vectors must have one length. Rows whose vector is null, zero or holds null or non-finite entries are left out.
    With no rows the index is empty. A list with very many rows is written by several tasks.
    """
    spark = vectors.sparkSession
    fit = vectors.where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("vector", lambda c: c != 0))
    rows = fit.select("doc_id", F.col("vector").cast("array<double>").alias("vector"), *filters)
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    sample = _unit(_stacked(drawn.select("vector").toArrow().column(0).combine_chunks())) if n else np.zeros((0, 1))
    k = min(lists or min(MOST_LISTS, max(1, n // LIST_ROWS)), max(1, len(np.unique(sample, axis=0))))
    centroids = _fit(sample, k) if len(sample) else np.zeros((0, 1))
    multiple = _multiple(sample, centroids) if len(sample) else MULTIPLES[0]
    shared = spark.sparkContext.broadcast(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (_unit(_stacked(b.column(1))) @ shared.value.T).argmax(1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], [*b.schema.names, "list"])

    placed = rows.mapInArrow(nearest, _with_list(rows))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (64 * LIST_ROWS * max(k, 1)) + 1)))  # parts of a list: more only where lists are long
    placed.repartition("list", part).write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    table = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return VectorIndex(path, tuple(filters), multiple)


def search(queries: DataFrame, index: VectorIndex, pool: int, where: Column | None = None) -> DataFrame:
    """query_id, doc_id and score (cosine, rounded to 9 places) of each query's ``pool`` best found, of rows that pass ``where``.

    Queries (query_id, vector) are a checked batch. The score is exact; which rows are looked at depends on the lists
    probed. Queries without a vector find nothing.
    """
    spark = queries.sparkSession
    numbers, centroids = index.centroids(spark)
    asked = collected(queries.where("vector is not null"), "query_id", "vector")
    schema = "query_id long, doc_id long, score double"
    if not asked or not len(numbers):
        return spark.createDataFrame([], schema)
    q = _unit(np.array([r["vector"] for r in asked], float))
    ids = np.array([r["query_id"] for r in asked])
    passed = index.rows(spark) if where is None else index.rows(spark).where(where)
    counts = np.zeros(len(numbers), np.int64)
    place = {int(n): i for i, n in enumerate(numbers)}
    for r in passed.groupBy("list").count().collect():  # a row a list; reads the filters' columns only
        counts[place[r["list"]]] = r["count"]
    probed = _probed(q @ centroids.T, counts, index.multiple * pool)
    lists = [int(numbers[i]) for i in np.flatnonzero(probed.any(0))]
    by_list = {int(numbers[i]): np.flatnonzero(probed[:, i]) for i in np.flatnonzero(probed.any(0))}
    shared = spark.sparkContext.broadcast((q, ids, by_list))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, by_list = shared.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in batches:
            if not b.num_rows:
                continue
            at, docs, v = b.column(2).to_numpy(), b.column(0).to_numpy(), _unit(_stacked(b.column(1)))
            parts = [held]
            for number in np.unique(at):
                rows, of = np.flatnonzero(at == number), by_list[int(number)]
                s = np.round(q[of] @ v[rows].T, 9)
                parts.append((np.repeat(of, len(rows)), np.tile(docs[rows], len(of)), s.ravel()))
            who, doc, s = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((doc, -s, who))
            who, doc, s = who[order], doc[order], s[order]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            keep = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)])) < pool
            held = (who[keep], doc[keep], s[keep])
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "doc_id", "score"])

    found = passed.where(F.col("list").isin(lists)).select("doc_id", "vector", "list")
    return best(found.mapInArrow(score, schema), pool)


def refreshed(index: VectorIndex, changed: DataFrame) -> VectorIndex:
    """The index with ``changed`` rows (doc_id, vector, filters) in place of those of the same id; a null vector removes one.

    Only the partitions that lose or gain rows are written again; centroids and the multiple stay, so an index that
    has grown many times over should be built anew.
    """
    spark = changed.sparkSession
    numbers, centroids = index.centroids(spark)
    shared = spark.sparkContext.broadcast(centroids)
    fresh = changed.where(F.col("vector").isNotNull()).select("doc_id", F.col("vector").cast("array<double>").alias("vector"), *index.filters)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = numbers[(_unit(_stacked(b.column(1))) @ shared.value.T).argmax(1)] if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], [*b.schema.names, "list"])

    placed = fresh.mapInArrow(nearest, _with_list(fresh))
    old = index.rows(spark)
    ids = changed.select("doc_id").distinct()
    touched = sorted({r["list"] for r in old.join(ids, "doc_id", "left_semi").select("list").distinct().collect()} | {r["list"] for r in placed.select("list").distinct().collect()})
    kept = old.where(F.col("list").isin(touched)).join(ids, "doc_id", "left_anti").select(placed.columns)
    new = written(kept.unionByName(placed), "refreshed")
    gone = [n for n in touched if new.where(F.col("list") == n).isEmpty()]
    new.repartition("list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{index.path}/rows")
    for n in gone:  # a list that lost its last row is told as an empty one
        old.where("false").drop("list").write.mode("overwrite").parquet(f"{index.path}/rows/list={n}")
    return index

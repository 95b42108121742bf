"""Approximate nearest neighbours by largest inner product: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample, as is the number of lists to probe: the
fewest that hold ``COARSE_RECALL`` of the neighbours of some sampled vectors within the sample. Every row is then
indexed: its nearest centroid names its list, and its residual is coded in 4-dimensional parts of one byte each.

Lists are dealt into blocks of about ``BLOCK_ROWS`` rows (a list that holds a third of all rows is many blocks), and
the queries that probe a list into sets of about ``QUERY_ROWS``: a list is sent once for each of its own sets, a list
that nothing probes not at all. In each (block, query set), tables of the inner products of a query's parts with all
codewords give the approximate products of all rows. The best ``SHORTLIST`` are reranked with the original vectors in
double precision, and with them all rows as near as the last of them but for what coding usually changes in a product:
of many nearly equal vectors the codes cannot tell which are nearest. The best k of each block meet in a ranking by
query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.plans.shared import written

SAMPLE_ROWS = 20_000
PART = 4
WORDS = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 8192
SHORTLIST = 64
COARSE_RECALL = 0.97
QUERY_EVERY = 20
NEAREST = 20


@dataclass(frozen=True)
class Index:
    """Fitted parameters. Parts beyond the vector's end are zero."""

    centroids: np.ndarray  # (lists, dimensions)
    books: np.ndarray  # (parts, words, PART)
    probes: int
    #: Root mean square of what coding changes in one component.
    blur: float = 0.0

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return _closest(x, self.centroids)

    def codes_of(self, residual: np.ndarray) -> np.ndarray:
        parts = _parts(residual)
        return np.stack([_closest(p, b) for p, b in zip(parts, self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codewords: (queries, parts, words)."""
        return np.einsum("pqd,pwd->qpw", _parts(q), self.books)


def _closest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each row of x the place of the closest row of ``to``, some rows at a time."""
    half = 0.5 * (to**2).sum(1)
    step = max(1, (1 << 22) // len(to))
    found = [np.argmax(x[at : at + step] @ to.T - half, 1) for at in range(0, len(x), step)]
    return np.concatenate(found) if found else np.zeros(0, np.intp)


def _parts(x: np.ndarray) -> np.ndarray:
    n = -(-x.shape[1] // PART)
    padded = np.zeros((len(x), n * PART), x.dtype)
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), n, PART).transpose(1, 0, 2)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's means from k distinct rows; a mean that loses all its rows stays where it is."""
    distinct = np.unique(x, axis=0)
    at = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = _closest(x, at)
        sums = np.zeros_like(at)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(at))
        at[n > 0] = sums[n > 0] / n[n > 0, None]
    return at


def fit(sample: np.ndarray, lists: int, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    centroids = _means(sample, lists, 10, rng)
    near = _closest(sample, centroids)
    parts = _parts(sample - centroids[near])
    books = np.zeros((len(parts), WORDS, PART))
    for book, p in zip(books, parts, strict=True):
        words = _means(p, WORDS, 6, rng)
        book[: len(words)] = words
        book[len(words) :] = words[0]
    coded = np.stack([b[_closest(p, b)] for p, b in zip(parts, books, strict=True)])
    blur = float(np.sqrt(((parts - coded) ** 2).sum() / sample.size))
    asked = rng.permutation(len(sample))[:300]
    product = sample[asked] @ sample.T
    product[np.arange(len(asked)), asked] = -np.inf
    k = min(NEAREST, len(sample) - 1)
    if k < 1:
        return Index(centroids, books, len(centroids), blur)
    best = np.argpartition(-product, k - 1, 1)[:, :k]
    order = np.argsort(-(sample[asked] @ centroids.T), 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None], 1)
    needed = np.sort(np.take_along_axis(place, near[best], 1).ravel())
    return Index(centroids, books, int(needed[math.ceil(COARSE_RECALL * len(needed)) - 1]) + 1, blur)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), kind) for v in column]).astype(np.float64)


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id (long) and vector (array<float> if it was so, else array<double>) of the rows that can take part.

    Left out: null ids, and vectors that are null, empty, zero, or hold null or non-finite components. If lengths
    differ, vectors of the most frequent length take part: others have no inner product with them.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_column] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(kind).alias("vector"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.where("vec_id is not null and size(vector) > 0").where(~F.exists("vector", odd) & F.exists("vector", lambda v: v != 0))
    lengths = [(r["count"], r["n"]) for r in rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()]
    return rows.where(F.size("vector") == (lengths[0][1] if lengths else 0))


def _indexed(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            stored = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)
            x = stored.astype(np.float64)
            lists = index.lists_of(x)
            codes = index.codes_of(x - index.centroids[lists])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in stored], pa.binary())],
                ["vec_id", "list", "code", "vec"],
            )

    return run


def _probed(shared, sizes: list[int], k: int, kind: str):
    """(query_id, list, query vector) of the lists to probe: enough to hold k rows besides the query's own, if there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        held = np.array(sizes)
        step = max(1, (1 << 21) // len(held))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                x = _matrix(b.column(1), kind)
                order = np.argsort(-(x @ index.centroids.T), 1, kind="stable")
                enough = (np.cumsum(held[order], 1) < k + 1).sum(1) + 1
                n = np.minimum(np.maximum(enough, index.probes), order.shape[1])
                row = pa.array(np.repeat(np.arange(len(x)), n))
                lists = np.concatenate([o[:m] for o, m in zip(order, n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(lists), b.column(1).take(row)], ["query_id", "list", "query"])

    return run


def _best_of_block(shared, k: int, shortlist: int, kind: str):
    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        index: Index = shared.value
        out: list[list[np.ndarray]] = [[], [], []]
        if members.num_rows and asked.num_rows:
            members = members.sort_by("vec_id")  # equal products then go to smaller ids
            ids = members.column("vec_id").to_numpy()
            codes = np.stack([np.frombuffer(c.as_py(), np.uint8) for c in members.column("code")]).astype(np.intp)
            vectors = _matrix(members.column("vec"), kind)
            centroid = index.centroids[members.column("list")[0].as_py()]
            queries, names = _matrix(asked.column("query"), kind), asked.column("query_id").to_numpy()
            for at in range(0, len(names), 64):
                q, name = queries[at : at + 64], names[at : at + 64]
                tables = index.tables(q)
                near = np.repeat((q @ centroid)[:, None], len(ids), 1)
                for part in range(codes.shape[1]):
                    near += tables[:, part, codes[:, part]]
                near[name[:, None] == ids[None]] = -np.inf
                keep = min(shortlist, len(ids))
                least = np.partition(near, len(ids) - keep, 1)[:, len(ids) - keep] - index.blur * np.sqrt((q * q).sum(1))
                for i, row in enumerate(near):
                    short = np.flatnonzero((row >= least[i]) & (row > -np.inf))
                    exact = (vectors[short] * q[i]).sum(1)
                    first = np.lexsort((ids[short], -exact))[:k]
                    for column, value in zip(out, (np.full(len(first), name[i]), ids[short[first]], exact[first])):
                        column.append(value)
        whole = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": pa.array(whole[0].astype(np.int64)), "vec_id": pa.array(whole[1].astype(np.int64)), "score": pa.array(whole[2].astype(np.float64))})

    return run


def nearest(vectors: DataFrame, k: int = NEAREST, query_every: int = QUERY_EVERY, sample_rows: int = SAMPLE_ROWS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: the k nearest found of each query, ties to smaller ids.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows with another id. Rows that
    ``usable`` leaves out take no part. A query with fewer than k candidates gets all of them. Repeated rows of one
    query count once; repeated rows of a candidate count each. Without rows there is no result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_rows / total))
    drawn = rows.where(draw).select("vector").limit(2 * sample_rows).toArrow().column("vector").to_pylist()
    drawn = drawn or rows.select("vector").limit(1).toArrow().column("vector").to_pylist()
    lists = int(min(4096, max(8, math.sqrt(total) / 4)))
    index = fit(np.array(drawn, np.float64), min(lists, len(drawn)))
    shared = spark.sparkContext.broadcast(index)  # of fixed size: lists, words and dimensions
    kind = "<f4" if dict(rows.dtypes)["vector"] == "array<float>" else "<f8"
    stored = written(rows.mapInArrow(_indexed(shared, kind), "vec_id long, list int, code binary, vec binary"), "ivf")
    sizes = [0] * len(index.centroids)
    for r in stored.groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    asked = stored.where(F.pmod("vec_id", F.lit(query_every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")).dropDuplicates(["query_id"])
    probes = asked.mapInArrow(_probed(shared, sizes, k, kind), "query_id long, list int, query binary")
    sets = [0] * len(sizes)
    for r in probes.groupBy("list").count().collect():  # a row for each list
        sets[r["list"]] = -(-r["count"] // QUERY_ROWS)
    of_list = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("list") + 1)
    blocks = of_list([max(1, -(-n // BLOCK_ROWS)) for n in sizes])
    members = stored.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    members = members.where(of_list(sets) > 0).withColumn("part", F.explode(F.sequence(F.lit(0), of_list(sets) - 1)))
    probes = probes.withColumn("part", F.pmod(F.xxhash64("query_id"), of_list(sets)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["list", "block", "part"]
    met = members.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(_best_of_block(shared, k, max(SHORTLIST, k), kind), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

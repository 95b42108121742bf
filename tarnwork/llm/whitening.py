"""Whitening of embeddings by shifted CholeskyQR.

The rows of the table, centred, are a tall matrix X that no task holds. A pass over the table adds up a Gram matrix of
small size, from its Cholesky factor comes a triangular R1, and in the next pass every row is solved against R1 before
its products are added up. Q = X inv(R1) is closer to orthonormal than X, so the following factors lose less: after
two or three passes the factors compose to R = ... R2 R1 with X = Q R and Q orthonormal to rounding, whatever the
condition of X. The singular values and right vectors of the small R are those of X, without the squared condition of
a covariance matrix.

The first factor is taken of the Gram matrix plus a small multiple of the identity, which keeps it positive definite
where columns depend on each other. Directions without any variance stay at zero through all passes; they are told by
the last Gram matrix, whose root takes the place of the last factor, and give no component.

Only sums come to the driver: one row for each dimension, or for each pair of dimensions. Spark adds them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 8
#: Passes of orthogonalisation at most, and the largest entry of the last Gram matrix minus the identity that ends them.
PASSES, SETTLED = 4, 1e-10
#: Eigenvalues below this share of the largest are rounding errors of zero.
NO_VARIANCE = 1e-13
#: Rows that are solved at a time.
SLICE = 4096

Rows = Callable[[pa.Array], np.ndarray]


def clean_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, has entries, and has no null or non-finite entry.

    Of several lengths only the most frequent one stays (of equally frequent ones the shortest).
    """
    fit = rows.where(F.size(vector) > 0).where(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    common = fit.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fit.where(F.size(vector) == (common["d"] if common else 0))


def _fixed_point(vectors: pa.Array) -> np.ndarray:
    """The rows of an array of lists of one length, as integers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(1024 * flat).astype(np.int64).reshape(len(vectors), -1) + 100_000


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield part, _fixed_point(part.column(column))


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _slices(batches, 0):
            n, total = n + len(x), x.sum(0) if total is None else total + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array([n] * len(total))], ["i", "total", "n"])

    by = vectors.mapInArrow(run, "i int, total long, n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    rows = sorted(by.collect())
    return (rows[0]["n"], [r["total"] for r in rows]) if rows else (0, [])


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    return (n * x - total) / n


def _gram(vectors: DataFrame, n: int, total: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The Gram matrix of the centred rows times ``factor`` (d by k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = factor.shape[1]
        found = np.zeros((k, k))
        for _, x in _slices(batches, 0):
            q = _centred(x, n, total) @ factor
            found += q.T @ q
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array((i * k + j).astype(np.int64)), pa.array(found[i, j])], ["at", "v"])

    k = factor.shape[1]
    found = np.zeros(k * k)
    for at, v in vectors.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        found[at] = v
    found = found.reshape(k, k)
    return found + np.triu(found, 1).T


def _inverse(r: np.ndarray) -> np.ndarray:
    """The inverse of an upper triangular matrix, by substitution."""
    d = len(r)
    out = np.zeros((d, d))
    for i in range(d - 1, -1, -1):
        out[i] = (np.eye(d)[i] - r[i, i + 1 :] @ out[i + 1 :]) / r[i, i]
    return out


def _spread(vectors: DataFrame, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (as rows) of the centred rows."""
    d = len(total)
    factor, r = np.eye(d), np.eye(d)
    for k in range(PASSES):
        g = _gram(vectors, n, total, factor)
        if k and np.abs(g - np.eye(d)).max() < SETTLED:
            break
        if k + 1 == PASSES or not np.trace(g):
            break
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(g)
        if k:  # later Gram matrices are near the identity, but for directions without variance
            shift = 1e-15 * d
        step = np.linalg.cholesky(g + min(shift, 1e-8 * np.trace(g)) * np.eye(d)).T
        factor, r = factor @ _inverse(step), step @ r
    lengths, turn = np.linalg.eigh(g)
    _, s, w = np.linalg.svd((np.sqrt(np.maximum(lengths, 0)) * turn).T @ r)
    return s, w


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row with a whole vector and each component: its whitened coordinate, and what holds for all rows.

    Entries c count as floor(1024 c) + 100000. Returns ``key``, component (int, from 1), n (rows), deviation (long, the
    exact sum over dimensions of (n x - S)^2; an error where it passes a long), whitened, explained and identity_error
    (see ``identity_error``). Components come by falling variance, their largest entry is positive, and of the first
    ``components`` those without variance are left out: equal rows, or one row alone, give no rows, and neither does an
    empty table. Rows without a whole vector give none (``clean_vectors``). Keys may be null or repeat; each row counts.
    Other columns are ignored.
    """
    fit = clean_vectors(rows, vector).select(F.col(key).alias(key), F.col(vector).cast("array<double>").alias("v"))
    kind = fit.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = fit.select("v")
    n, sums = _sums(vectors)
    total = np.array(sums, np.int64)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    s, w = _spread(vectors, n, total)
    e = s * s / n
    kept = int((e[:components] > NO_VARIANCE * e[0]).sum())
    if not kept:
        return rows.sparkSession.createDataFrame([], schema)
    axes = w[:kept].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(kept)])
    factor = axes / np.sqrt(e[:kept])
    explained = e[:kept] / e.sum()
    error = identity_error(_gram(vectors, n, total, factor), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, 1):
            far = n * x - total
            if (far.astype(float) ** 2).sum(1).max() > 9.2e18:
                raise OverflowError("a deviation passes the range of a long")
            deviation = (far * far).sum(1)
            out = (far / n) @ factor
            m = len(x)
            columns = [part.column(0).take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n))]
            columns += [pa.array(np.repeat(deviation, kept)), pa.array(out.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fit.mapInArrow(run, schema)


def identity_error(gram: np.ndarray, n: int) -> float:
    """Largest absolute entry of the covariance of whitened rows (their Gram matrix over n) minus the identity."""
    return float(np.abs(gram / n - np.eye(len(gram))).max())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened on their first eight components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

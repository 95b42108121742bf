"""Soft-membership mixing to target weights.

A classifier trained on the labelled table gives every document a posterior over domains, so a document belongs to
all of them in part. Rates, one for each document and never negative, are then fitted so that the expected tokens of
each domain, sum over documents of rate * tokens * posterior, match the targets.

The fit is projected-gradient least squares, starting from rate 1: each round measures the domains' totals, and each
document moves along its own share of the misfit and is cut at 0. A document's rate depends on its posterior and the
past misfits only, so a round is one aggregate over (tokens, posterior) rows, and what travels is one number for each
domain. Misfits are scaled by the domains' Gram matrix, measured once, which makes rounds few.

Tokens are ids of a public vocabulary: they are what totals count, and the classifier's features.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from tarnwork.llm.tokens import END_OF_TEXT, encoder, vocabulary_path
from tarnwork.plans.shared import written

#: Domains by label: quality and toxic of the labelled table.
DOMAINS = ("low", "high", "toxic")
TARGETS = (0.2, 0.75, 0.05)
TRAIN_DOCS = 4_000
ROUNDS = 40
STEP = 0.7
CLOSE = 1e-4
#: Weight of the squared weights in the classifier's loss.
SHRINK = 0.01


@dataclass(frozen=True)
class Posterior:
    """Multinomial logistic regression on the logarithms of a text's token counts."""

    weights: np.ndarray  # (vocabulary, domains)
    bias: np.ndarray

    def of(self, ids: list[int]) -> np.ndarray:
        at, counts = _bag(ids)
        z = counts @ self.weights[at] + self.bias
        p = np.exp(z - z.max())
        return p / p.sum()


@dataclass(frozen=True)
class Fit:
    """Expected and wanted tokens of each domain, and whether they agree to ``CLOSE`` of all wanted tokens."""

    have: list[float]
    want: list[float]
    reached: bool


def _bag(ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(np.array(ids, np.int64), return_counts=True)
    return at, np.log1p(n)


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain (its place in DOMAINS) of labelled documents.

    Toxic wins over quality. Rows with a null id, or without either label, are left out; of several rows for one
    document the most toxic and then the best counts.
    """
    rows = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    domain = F.when(F.col("toxic") > 0, 2.0).when(F.col("quality") > 0, 1.0).otherwise(0.0)
    return rows.select("doc_id", domain.alias("domain"))


def _ids_met(rows: DataFrame) -> np.ndarray:
    """Sorted distinct token ids of the rows' bags: one vocabulary at most."""
    return np.sort(rows.select(F.explode("bag.ids").alias("id")).distinct().toArrow()["id"].to_numpy()).astype(np.int64)


def _vectors(rows: DataFrame, met: np.ndarray) -> DataFrame:
    """domain, and the rows' bags as vectors over the ids that any of them has."""

    @F.udf(VectorUDT())
    def vector(ids, counts):
        return SparseVector(max(len(met), 1), np.searchsorted(met, ids), counts)

    return rows.select(vector("bag.ids", "bag.counts").alias("bag"), "domain")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, path: str | None = None) -> Posterior | None:
    """A model from ``text`` to domain posteriors, fitted on about ``train_docs`` labelled documents; None without two domains.

    The fit has weights for the ids that the sample has: those of all others are zero whatever it finds, and the driver
    would keep tens of vectors of the vocabulary's size for them.
    """
    known = domain_of_labels(labels)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_docs / max(known.count(), 1)))
    rows = docs.where("text is not null").select("doc_id", "text").join(known.where(draw), "doc_id")
    path = path or vocabulary_path()

    @F.udf("ids array<int>, counts array<double>")
    def bag(text):
        return tuple(x.tolist() for x in _bag(encoder(path)(text)))

    rows = written(rows.select(bag("text").alias("bag"), "domain"), "labelled")
    if rows.select("domain").distinct().limit(2).count() < 2:
        return None
    met = _ids_met(rows)
    model = LogisticRegression(featuresCol="bag", labelCol="domain", family="multinomial", regParam=SHRINK, maxIter=25).fit(_vectors(rows, met))
    found, bias = model.coefficientMatrix.toArray().T, model.interceptVector.toArray()
    # a model that has not met the last domains has no column for them
    none = len(DOMAINS) - len(bias)
    weights = np.zeros((END_OF_TEXT + 1, len(DOMAINS)))
    weights[met, : len(bias)] = found[: len(met)]
    return Posterior(weights, np.pad(bias, (0, none), constant_values=-np.inf))


def _scored(shared, path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, model = encoder(path), shared.value
        equal = np.full(len(DOMAINS), 1 / len(DOMAINS))
        for b in batches:
            ps, tokens = [], []
            for text in b.column(len(keep)):
                ids = encode(text.as_py() or "")
                tokens.append(len(ids))
                ps.append(model.of(ids) if model is not None else equal)
            p = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(ps) if ps else np.zeros(0)), len(DOMAINS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], p, pa.array(tokens, pa.int64())], [*keep, "p", "tokens"])

    return run


def posteriors(docs: DataFrame, model: Posterior | None, keep: list[str], path: str | None = None) -> DataFrame:
    """Columns ``keep`` with p (array<double>, a posterior for each domain) and tokens (long: ids of the text).

    A null text counts as empty. Without a model every domain is equally likely.
    """
    keep = [c for c in keep if c not in ("p", "tokens")]
    rows = docs.select(*keep, F.col("text").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: vocabulary and domains
    schema = StructType(rows.schema.fields[:-1]).add("p", ArrayType(DoubleType())).add("tokens", LongType())
    return rows.mapInArrow(_scored(shared, path or vocabulary_path(), keep), schema)


def _rate(moves: list[list[float]]) -> Column:
    """A document's rate after these moves: 1, changed by posterior * move and cut at 0 each time."""
    rate = F.lit(1.0)
    if not moves:
        return rate
    steps = F.array(*[F.array(*map(F.lit, m)) for m in moves])
    return F.aggregate(steps, rate, lambda r, m: F.greatest(F.lit(0.0), r + sum(F.col("p")[d] * m[d] for d in range(len(DOMAINS)))))


def fit_rates(rows: DataFrame, targets: tuple[float, ...] = TARGETS, budget: float | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, Fit]:
    """``rows`` (p, tokens, others) with ``rate`` (double), and how the domains' expected totals at those rates fit.

    targets: share of each domain in ``budget`` tokens (all tokens there are, unless given). Rows without tokens keep
    rate 1. A domain that no document has any share of cannot be matched; then, or if ``rounds`` are not enough, the
    fit says that it is not reached. ``rows`` is read once a round, so it should be a written table.
    """
    n = len(DOMAINS)
    t = F.col("tokens").cast("double")
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    first = rows.agg(F.sum(t).alias("t"), *[F.sum(t * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}{j}") for i, j in cells]).first()
    total = first["t"] or 0.0
    if not total:
        return rows.withColumn("rate", F.lit(1.0)), Fit([0.0] * n, [0.0] * n, True)
    gram = np.zeros((n, n))
    for i, j in cells:
        gram[i, j] = gram[j, i] = first[f"g{i}{j}"] / total
    want = np.array(targets) / sum(targets) * ((budget or total) / total)
    solve = np.linalg.pinv(gram + 1e-6 * np.eye(n))
    moves: list[list[float]] = []
    have = np.zeros(n)
    for _ in range(rounds + 1):
        rated = rows.withColumn("rate", _rate(moves))
        sums = rated.agg(*[F.sum(F.col("rate") * t * F.col("p")[i]).alias(f"s{i}") for i in range(n)]).first()
        have = np.array([sums[f"s{i}"] or 0.0 for i in range(n)]) / total
        miss = want - have
        if np.abs(miss).max() <= CLOSE * want.sum() or len(moves) == rounds:
            break
        moves.append([float(x) for x in STEP * solve @ miss])
    reached = bool(np.abs(want - have).max() <= CLOSE * want.sum())
    return rows.withColumn("rate", _rate(moves)), Fit([float(x) for x in have * total], [float(x) for x in want * total], reached)


def mixed(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, seed: int = 11, strict: bool = False) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and once more with the odds of the rest.

    The draw is a hash of the id and the text, so a rerun gives the same rows. Columns stay; a null text counts as
    empty and keeps rate 1. Targets that no rates reach (of a domain that no document has any share of) are told by a
    warning, with the nearest totals; with ``strict`` they are an error.
    """
    keep = docs.columns
    packed = docs.select(F.struct(*keep).alias("__row"), "text")
    scored = written(posteriors(packed, train(docs, labels), ["__row"]), "posteriors")
    rated, fit = fit_rates(scored, targets)
    if not fit.reached:
        said = f"mixing targets not reached: tokens by domain {fit.have}, wanted {fit.want}"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("__row.doc_id"), F.col("__row.text")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("rate") + chance).cast("int")
    return rated.withColumn("__n", copies).where("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and mixing rate of every document, with the totals that the rates give and those wanted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = written(posteriors(docs, train(docs, labels), ["doc_id"]), "posteriors")
    rated, fit = fit_rates(scored)
    shares = [F.round(F.col("p")[i], 9).alias(f"p_{name}") for i, name in enumerate(DOMAINS)]
    totals = [F.lit(x).alias(f"{kind}_{name}") for kind, values in (("expected", fit.have), ("target", fit.want)) for x, name in zip(values, DOMAINS, strict=True)]
    return rated.select("doc_id", "tokens", *shares, "rate", F.lit(fit.reached).alias("reached"), *totals)

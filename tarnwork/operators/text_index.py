"""A stored text index: postings in blocks that carry their largest weight, and searches that skip blocks.

A document's weight of a term is the sum over fields of field weight times occurrences, and its score for a query the
sum over the query's distinct terms. Documents are dealt into ranges of similar size, since long ones have large
weights; a block holds the postings of one term in one range, with the largest weight and the count. The sum of the
largest weights of a query's terms bounds every score in a range. A search reads these bounds first, without the
postings. It then scores, for each query, the ranges of the highest bounds until they hold enough documents, takes
the score of the last wanted one as a bar, and scores of all other ranges only those whose bound reaches it. What it
finds is what scoring every document would find.

Blocks are stored by term, so a search reads the partitions of its terms; a task holds one range at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.operators.search import best, collected
from tarnwork.plans.shared import written

#: Documents of a range, and bytes of their fields, about; levels of size; partitions of blocks by term.
RANGE_DOCS, RANGE_BYTES, LEVELS, BUCKETS = 2_048, 1 << 25, 256, 32
_TERM = re.compile("[a-z0-9]+")
_BLOCK = "bucket int, term string, at long, n long, most double, docs array<long>, weights array<double>"


def terms(text: str | None) -> list[str]:
    """Runs of a-z and 0-9 of lower-cased text, with repeats."""
    return _TERM.findall((text or "").lower())


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


@dataclass(frozen=True)
class TextIndex:
    """A written index: its folder and the columns that filters can use."""

    path: str
    filters: tuple[str, ...]

    def blocks(self, spark: SparkSession) -> DataFrame:
        """bucket, term, at (range), n, most (largest weight), docs and weights."""
        return spark.read.schema(_BLOCK).parquet(f"{self.path}/blocks")

    def documents(self, spark: SparkSession) -> DataFrame:
        """doc_id, at, and the columns of filters."""
        return spark.read.parquet(f"{self.path}/documents")


def _blocks(weights: list[float]):
    """Reads the documents of a range (doc_id, at, fields); a block for each of their terms."""

    def run(table: pa.Table) -> pa.Table:
        docs, names = table.column("doc_id").to_pylist(), [f"f{i}" for i in range(len(weights))]
        place: dict[str, int] = {}
        rows, of, weight = [], [], []
        for i, texts in enumerate(zip(*(table.column(n).to_pylist() for n in names), strict=True)):
            total: Counter[str] = Counter()
            for w, t in zip(weights, texts, strict=True):
                for term, n in Counter(terms(t)).items():
                    total[term] += w * n
            rows += [i] * len(total)
            of += [place.setdefault(term, len(place)) for term in total]
            weight += total.values()
        keys = sorted(place)
        rank = np.empty(len(keys), np.int64)
        rank[[place[k] for k in keys]] = np.arange(len(keys))
        own = rank[np.array(of, np.int64)]
        order = np.argsort(own, kind="stable")
        own, weight, rows = own[order], np.array(weight, float)[order], np.array(rows, np.int64)[order]
        counts = np.bincount(own, minlength=len(keys))
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        most = np.maximum.reduceat(weight, offsets[:-1]) if len(keys) else weight
        flat = lambda v: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v))
        columns = [pa.array([_bucket(k) for k in keys], pa.int32()), pa.array(keys, pa.string()), pa.array([table.column("at")[0].as_py()] * len(keys), pa.int64())]
        columns += [pa.array(counts), pa.array(most), flat(np.array(docs, np.int64)[rows]), flat(weight)]
        return pa.table(columns, ["bucket", "term", "at", "n", "most", "docs", "weights"])

    return run


def _ranges(rows: DataFrame, fields: list[str], weights: list[float], range_docs: int) -> DataFrame:
    """``rows`` with ``at``: a range of documents of similar size, bounded in documents and bytes."""
    length = lambda f: F.coalesce(F.octet_length(f), F.lit(0)).cast("long")
    sized = written(rows.withColumns({"__bytes": sum((length(f) for f in fields), F.lit(0)), "__size": sum((length(f) * w for f, w in zip(fields, weights)), F.lit(0.0))}), "fields")
    cuts = sized.agg(F.percentile_approx("__size", [i / LEVELS for i in range(1, LEVELS)], 10_000).alias("q")).first()["q"]
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or []))] or [F.lit(0.0)])
    sized = sized.withColumn("__level", F.size(F.filter(bounds, lambda c: c <= F.col("__size"))))
    start, of, held = 0, {}, [0, 0]
    for r in sorted(sized.groupBy("__level").agg(F.count("*").alias("n"), F.sum("__bytes").alias("bytes")).collect()):  # LEVELS rows at most
        held = [held[0] + r["n"], held[1] + r["bytes"]]
        parts = max(-(-held[0] // range_docs), -(-held[1] // RANGE_BYTES), 1)
        if parts > 1:  # small levels share the range before them while it has room
            start, held = start + 1, [r["n"], r["bytes"]]
            parts = max(-(-held[0] // range_docs), -(-held[1] // RANGE_BYTES), 1)
        of[r["__level"]], start = (start, parts), start + parts - 1
        if parts > 1:
            start, held = start + 1, [0, 0]
    table = F.create_map(*[F.lit(x) for level, (s, p) in of.items() for x in (level, F.struct(F.lit(s).cast("long").alias("s"), F.lit(p).cast("long").alias("p")))]) if of else None
    if table is None:
        return sized.withColumn("at", F.lit(0).cast("long")).drop("__bytes", "__size", "__level")
    own = F.element_at(table, F.col("__level"))
    return sized.withColumn("at", own["s"] + F.pmod(F.xxhash64("doc_id"), own["p"])).drop("__bytes", "__size", "__level")


def build(docs: DataFrame, path: str, fields: dict[str, float], filters: tuple[str, ...] = (), range_docs: int = RANGE_DOCS) -> TextIndex:
    """Write the index of ``docs`` (doc_id, the text columns of ``fields`` with their weights, ``filters``) to ``path``.

    Ids should be unique; rows without one are left out. A null text has no terms. What stands at ``path`` is replaced.
    """
    weights = [float(w) for w in fields.values()]
    placed = _ranges(docs.where("doc_id is not null").select("doc_id", *filters, *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]), [f"f{i}" for i in range(len(fields))], weights, range_docs)
    placed.select("doc_id", "at", *filters).write.mode("overwrite").parquet(f"{path}/documents")
    made = placed.drop(*filters).groupBy("at").applyInArrow(_blocks(weights), _BLOCK)
    made.repartition("bucket", F.col("at") % 4).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    return TextIndex(path, tuple(filters))


def _scored(shared, pool: int):
    """Reads the asked blocks of a range, and which queries score it; the best of each of these queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = shared.value
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            lists = left.column("docs").combine_chunks()
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            weight = left.column("weights").combine_chunks().values.to_numpy()
            docs, local = np.unique(flat, return_inverse=True)
            ok = None
            allowed = right.column("allowed")[0].as_py()
            if allowed is not None:
                ok = np.isin(docs, np.array(allowed, np.int64))
            span = {t: (a, b) for t, a, b in zip(left.column("term").to_pylist(), offsets[:-1], offsets[1:], strict=True)}
            for q in right.column("queries")[0].as_py():
                parts = [span[t] for t in asked[q] if t in span]
                if not parts:
                    continue
                total = np.bincount(np.concatenate([local[a:b] for a, b in parts]), np.concatenate([weight[a:b] for a, b in parts]), len(docs))
                hit = np.flatnonzero(total > 0 if ok is None else (total > 0) & ok)
                if len(hit) > pool:
                    bar = np.partition(total[hit], -pool)[-pool]
                    hit = hit[total[hit] >= bar]
                    hit = hit[np.lexsort((docs[hit], -total[hit]))[:pool]]
                out.append((np.full(len(hit), q, np.int64), docs[hit], total[hit]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], ["query_id", "doc_id", "score"])

    return run


def search(queries: DataFrame, index: TextIndex, pool: int, where: Column | None = None) -> DataFrame:
    """query_id, doc_id, score of each query's ``pool`` best documents with any of its terms, ties to smaller ids.

    Queries (query_id, text) are a checked batch. ``where`` is a condition on the columns of filters.
    """
    spark = queries.sparkSession
    rows = collected(queries, "query_id", "text")
    asked = {r["query_id"]: sorted(set(terms(r["text"]))) for r in rows}
    schema = "query_id long, doc_id long, score double"
    every = sorted({t for found in asked.values() for t in found})
    if not every:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(asked)
    wanted = F.broadcast(spark.createDataFrame([(q, t) for q, found in asked.items() for t in found], "query_id long, term string"))  # of a checked batch
    known = F.broadcast(spark.createDataFrame([(t,) for t in every], "term string"))
    blocks = index.blocks(spark).where(F.col("bucket").isin(sorted({_bucket(t) for t in every})))
    if len(every) <= 1000:
        blocks = blocks.where(F.col("term").isin(every))
    bounds = blocks.select("term", "at", "n", "most").join(wanted, "term").groupBy("query_id", "at").agg(F.sum("most").alias("bound"), F.max("n").alias("least"))
    before = Window.partitionBy("query_id").orderBy(F.desc("bound"), "at").rowsBetween(Window.unboundedPreceding, -1)
    bounds = written(bounds.withColumn("first", F.coalesce(F.sum("least").over(before), F.lit(0)) < pool), "bounds")
    allowed = None if where is None else index.documents(spark).where(where).groupBy("at").agg(F.collect_list("doc_id").alias("allowed"))  # a range is bounded

    def scored(pairs: DataFrame) -> DataFrame:
        of = pairs.groupBy("at").agg(F.collect_list("query_id").alias("queries"))  # of a checked batch
        of = of.withColumn("allowed", F.lit(None).cast("array<long>")) if allowed is None else of.join(allowed, "at")
        needed = blocks.select("term", "at", "docs", "weights").join(known, "term").join(pairs.select("at").distinct(), "at", "left_semi")
        return needed.groupBy("at").cogroup(of.groupBy("at")).applyInArrow(_scored(shared, pool), schema)

    heads = written(best(scored(bounds.where("first")), pool), "heads")
    bars = heads.groupBy("query_id").agg(F.when(F.count("*") >= pool, F.min("score")).alias("bar"))
    rest = bounds.where("not first").join(bars, "query_id", "left").where("bound >= coalesce(bar, 0)")
    return best(heads.unionByName(scored(rest)), pool)

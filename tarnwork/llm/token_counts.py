"""Token counts of documents in flat token files, by a separator scan.

A token file is a run of fixed-size blocks of little-endian 16-bit ids, without any index: documents follow each
other, each ended by one end-of-document id, and may lie across many blocks. (Spark writes no headerless binary
files, so a file is kept as rows (file_id, block, tokens) of a table; nothing but the order of blocks is known.)

Each block is searched for the separator as one vector. What a block leaves open is stitched by a prefix scan over
small rows: the tokens, separators and last separator of all blocks before it. The scan has two levels, groups of
blocks and blocks in a group, so that one very long file is not scanned in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm.tokens import END_OF_TEXT, encoder, vocabulary_path
from tarnwork.plans.shared import written

BLOCK_TOKENS = 1 << 16
GROUP_BLOCKS = 256


def _blocks(path: str, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special=False)
        held: list[np.ndarray] = []
        size, block, file_id = 0, 0, None
        ended: list[int | None] = []
        done: list[tuple[int, int]] = []  # (tokens so far at its separator, position in ``ended``) not yet written

        def out(ids: np.ndarray, docs: list[int | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file_id], pa.int32()), pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([docs], pa.list_(pa.int64()))],
                ["file_id", "block", "tokens", "doc_ids"],
            )

        for b in batches:
            for doc_id, text, part in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                file_id = part.as_py() if file_id is None else file_id
                ids = encode(text.as_py() or "")
                ids.append(END_OF_TEXT)
                held.append(np.array(ids, "<u2"))
                size += len(ids)
                ended.append(doc_id)
                done.append(size)
                if size >= block_tokens:
                    every = np.concatenate(held)
                    while len(every) >= block_tokens:
                        n = sum(d <= block_tokens for d in done)
                        yield out(every[:block_tokens], ended[:n])
                        every, ended, done = every[block_tokens:], ended[n:], [d - block_tokens for d in done[n:]]
                        block += 1
                    held, size = [every], len(every)
        if size:
            yield out(np.concatenate(held), ended)

    return run


def token_files(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write documents (doc_id, text) as token files, one for each partition: file_id, block, tokens, doc_ids.

    doc_ids names the documents that end in a block, to tell afterwards which document is which; the scan does not
    read it. A null text has no tokens but its separator. The separator's own string in a text is ordinary text here,
    several ids, so the separator's id stands in a file where a document ends and nowhere else.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("file_id"))
    blocks = rows.mapInArrow(_blocks(path or vocabulary_path(), block_tokens), "file_id int, block long, tokens binary, doc_ids array<long>")
    return written(blocks, "token-files", "zstd")


def _ends(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found = [], []
            for t in b.column(2):
                ids = np.frombuffer(t.as_py() or b"", "<u2")
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["file_id", "block", "n", "ends"])

    return run


def scan_token_files(files: DataFrame, end_id: int = END_OF_TEXT) -> DataFrame:
    """Documents in token files (file_id, block, tokens): file_id, ordinal, start, n_tokens, closed, block, place.

    ordinal (long) counts documents of a file from 0; start is the place of its first token in the file; n_tokens
    leaves the separator out. block and place (from 0) say at which separator of which block it ends. A file that does
    not end in a separator gives a last document with closed = false and neither. Every id equal to ``end_id`` ends a
    document. Blocks are ordered by number, which need not be gapless; they may have any lengths and be empty or null.
    """
    at_block = Window.partitionBy("file_id", "group").orderBy("block")
    before = at_block.rowsBetween(Window.unboundedPreceding, -1)
    seen = files.select("file_id", "block", "tokens").mapInArrow(_ends(end_id), "file_id int, block long, n long, ends array<long>")
    seen = seen.withColumn("group", F.expr(f"block div {GROUP_BLOCKS}"))
    zero = F.lit(0).cast("long")
    inner = seen.select(
        "*",
        F.coalesce(F.sum("n").over(before), zero).alias("n_in"),
        F.coalesce(F.sum(F.size("ends")).over(before), zero).alias("docs_in"),
    ).withColumn("last", F.when(F.size("ends") > 0, F.col("n_in") + F.element_at("ends", -1)))
    inner = inner.withColumn("last_in", F.last("last", ignorenulls=True).over(before))
    inner = written(inner, "blocks")
    groups = inner.groupBy("file_id", "group").agg(F.sum("n").alias("g_n"), F.sum(F.size("ends")).alias("g_docs"), F.max("last").alias("g_last"))
    earlier = Window.partitionBy("file_id").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "*",
        F.coalesce(F.sum("g_n").over(earlier), zero).alias("n_to"),
        F.coalesce(F.sum("g_docs").over(earlier), zero).alias("docs_to"),
    ).withColumn("g_end", F.col("n_to") + F.col("g_last"))
    carried = F.coalesce(F.last("g_end", ignorenulls=True).over(earlier), zero - 1)
    groups = groups.select("file_id", "group", "n_to", "docs_to", carried.alias("end_to"), "g_n", "g_docs", "g_end")
    stitched = inner.join(groups.select("file_id", "group", "n_to", "docs_to", "end_to"), ["file_id", "group"])
    first = F.coalesce(F.col("n_to") + F.col("last_in"), F.col("end_to")) + 1
    places = F.transform("ends", lambda e: F.col("n_to") + F.col("n_in") + e)
    stitched = stitched.select("file_id", "block", (F.col("docs_to") + F.col("docs_in")).alias("base"), first.alias("first"), places.alias("places"))
    found = stitched.select("file_id", "block", "base", "first", "places", F.posexplode("places").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("first")).otherwise(F.get("places", F.col("i") - 1) + 1)
    closed = found.select("file_id", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"), "block", F.col("i").alias("place"))
    totals = groups.groupBy("file_id").agg(F.sum("g_n").alias("n"), F.sum("g_docs").alias("ordinal"), F.coalesce(F.max("g_end"), zero - 1).alias("end"))
    tails = totals.where("n - 1 > end").select("file_id", "ordinal", (F.col("end") + 1).alias("start"), (F.col("n") - 1 - F.col("end")).alias("n_tokens"), F.lit(False).alias("closed"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("place"))
    return closed.unionByName(tails)


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from token files: doc_id, n_tokens, file_id, ordinal, start."""
    files = token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    named = files.select("file_id", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    return scan_token_files(files).join(named, ["file_id", "block", "place"]).select("doc_id", "n_tokens", "file_id", "ordinal", "start")

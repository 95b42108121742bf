"""Best-fit packing by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so a corpus of any size is a histogram of at most ``capacity`` counts.
The plan is made on that histogram:

1. Lengths above a small bound are sorted and cut into groups of equal cardinality; every length is rounded up to
   the largest of its group, which leaves a few sizes.
2. Few-size configurations (how many of each size share a sequence) are generated and used, fullest first, as often
   as counts allow.
3. The actual documents take the places of the rounded sizes, which gives slack back.
4. Small documents, longest first, go to the sequence in which they fit best; what is left opens new sequences.

A plan is a table of runs: so many documents of one length, in order, go to consecutive sequences at one offset.
Its size depends on the capacity and the number of groups, not on the corpus. Documents find their run by their rank
among those of equal length, which is counted in salts.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm.tokens import encoder, vocabulary_path
from tarnwork.plans.shared import written

CAPACITY = 2048
GROUPS = 512
#: Lengths up to capacity / SMALL_PART are placed by best fit.
SMALL_PART = 4
END_ID = 0
#: Rows of one length that are ranked in one task, about.
RANK_ROWS = 50_000


def _best_fill(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """Counts of each size (descending) that fill ``room`` as full as can be, by exact subset sums over bounded counts."""
    reach: list[tuple[int, int] | None] = [None] * (room + 1)  # (size index, previous sum)
    reach[0] = (-1, 0)
    for i, s in enumerate(sizes):
        if not left[i] or s > room:
            continue
        used = [0] * (room + 1)
        for total in range(s, room + 1):
            if reach[total] is None and reach[total - s] is not None and used[total - s] < left[i]:
                reach[total] = (i, total - s)
                used[total] = used[total - s] + 1
        if reach[room] is not None:
            break
    total = next(t for t in range(room, -1, -1) if reach[t] is not None)
    counts = [0] * len(sizes)
    while total:
        i, before = reach[total]
        counts[i] += 1
        total = before
    return counts


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_part: int = SMALL_PART) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every length from 1 to ``capacity``.

    The document of that length with rank first + i goes to sequence first sequence + i, at the offset.
    """
    small = capacity // small_part
    large = sorted((n for n in histogram if n > small and histogram[n]), reverse=True)
    total = sum(histogram[n] for n in large)
    runs: list[tuple[int, int, int, int, int]] = []
    taken = dict.fromkeys(histogram, 0)
    # groups of equal cardinality, longest first; a length may belong to two groups
    share, members, sizes, left = -(-total // groups) if total else 0, [], [], []
    for n in large:
        rest = histogram[n]
        while rest:
            if not members or left[-1] == share:
                members.append([])
                sizes.append(n)
                left.append(0)
            k = min(rest, share - left[-1])
            members[-1].append([n, k])
            left[-1] += k
            rest -= k
    for m in members:
        m.reverse()  # the shortest of a group first: those are used by the configurations that are built first
    sequences = 0
    open_runs: list[list[int]] = []  # [room, first sequence, count, filled]

    def take(group: int, count: int, filled: list[list[int]]) -> list[list[int]]:
        """Put one document of the group into each of ``count`` sequences, which come as [first, count, filled]."""
        out = []
        for first, n, full in filled:
            while n:
                length, have = members[group][0]
                k = min(n, have)
                runs.append((length, taken[length], k, first, full))
                taken[length] += k
                members[group][0][1] -= k
                if not members[group][0][1]:
                    members[group].pop(0)
                out.append([first, k, full + length])
                first, n = first + k, n - k
        left[group] -= count
        return out

    while any(left):
        head = next(i for i, n in enumerate(left) if n)  # the largest size left is in every configuration
        left[head] -= 1
        config = _best_fill(capacity - sizes[head], sizes, left)
        left[head] += 1
        config[head] += 1
        times = min(left[i] // c for i, c in enumerate(config) if c)
        filled = [[sequences, times, 0]]
        for i, c in enumerate(config):
            for _ in range(c):
                filled = take(i, times, filled)
        open_runs += [[capacity - full, first, n, full] for first, n, full in filled]
        sequences += times
    open_runs.sort()
    for length in sorted((n for n in histogram if n <= small and histogram[n]), reverse=True):
        rest = histogram[length]
        while rest:
            at = bisect.bisect_left(open_runs, [length])
            if at == len(open_runs):  # new sequences, each filled with as many of this length as fit
                each = capacity // length
                fresh = -(-rest // each)
                bisect.insort(open_runs, [capacity, sequences, fresh, 0])
                sequences += fresh
                at = bisect.bisect_left(open_runs, [length])
            room, first, n, full = open_runs.pop(at)
            # as many of this length as still fit into each, and no more
            each = min(room // length, -(-rest // n))
            for _ in range(each):
                k = min(n, rest)
                if k < n:
                    bisect.insort(open_runs, [room, first + k, n - k, full])
                if not k:
                    break
                runs.append((length, taken[length], k, first, full))
                taken[length] += k
                rest, room, full, n = rest - k, room - length, full + length, k
            if n and room:
                bisect.insort(open_runs, [room, first, n, full])
    return runs


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                ids = np.array(ids, "<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(rows, (doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes()))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def document_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32. Only documents above the capacity are cut."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path, capacity), schema)


def _placed(shared, names: list[str]):
    """Look each row's run up by (length, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        code = (runs[:, 0] << 44) | runs[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.searchsorted(code, (length << 44) | rank, "right") - 1
            sequence = runs[at, 3] + rank - runs[at, 1]
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(runs[at, 4])], [*names, "sequence_id", "offset"])

    return run


def _ranked(pieces: DataFrame, histogram: dict[int, int], rank_rows: int) -> DataFrame:
    """Add __rank (long, gapless from 0 among rows of equal length).

    A length of many rows is dealt into salts of about ``rank_rows``; a salt's first rank comes from the counts of the
    salts before it, which meet the rows in a join on (length, salt), by which the rows are dealt already.
    """
    salts = [-(-histogram.get(n, 0) // rank_rows) or 1 for n in range(1, max(histogram) + 1)]  # a number for each length
    many = F.element_at(F.array(*map(F.lit, salts)), F.col("length").cast("int"))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), many).cast("int"))
    counts = salted.groupBy("length", "__salt").count()
    earlier = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("__in", within).join(starts, ["length", "__salt"])
    return ranked.withColumn("__rank", (F.col("__before") + F.col("__in") - 1).cast("long"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Add sequence_id and offset (long) to rows that have doc_id, piece and length (long, 1 to ``capacity``).

    Sequences hold at most ``capacity``; offsets in a sequence are gapless from 0. Rows of equal length are ranked in
    salts and there by doc_id and piece, nulls first; repeated rows take places of their own. No rows give no rows.
    Rows are read several times, so ``pieces`` should be a written table.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in names), "sequence_id long, offset long"])
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().limit(capacity + 1).collect()}  # a row for each length
    if any(n is None or n < 1 or n > capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    if not histogram:
        return pieces.sparkSession.createDataFrame([], schema)
    runs = np.array(sorted(plan_packing(histogram, capacity, groups)), np.int64)
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # its size depends on the capacity and the groups
    ranked = _ranked(pieces, histogram, rank_rows)
    return ranked.select(*names, "__rank").mapInArrow(_placed(shared, names), schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its text's ids and then id 0; a null or empty text is id 0 alone. The string of a special token in a
    text is that token's id. Longer documents are cut into
    pieces of ``capacity``, of which the first may be shorter. Other columns are ignored.
    """
    return pack(written(document_pieces(docs, path or vocabulary_path(), capacity), "pieces"), capacity, groups)


def op3_lgs_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

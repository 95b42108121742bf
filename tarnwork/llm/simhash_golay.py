"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to 23. The binary Golay code
[23, 12, 7] is perfect: every segment is within distance 3 of exactly one codeword. The keys of a segment are the
indices of all codewords within distance 4 of it (one if the nearest is within 2, else six). Two segments at
distance 2 or less have a point within 1 of both, whose codeword is within 4 of both, so they share a key.

With 4 or fewer differing bits in all, pigeonhole leaves two cases: every segment differs in 2 bits or fewer, and a
key triple is shared; or one differs in 3 or 4, another in none and the last in 1 at most, and a pair of a whole
segment and a key is shared. Joining on these (36 and 33 or more bits) and verifying misses no link.

Documents are first reduced to distinct fingerprints, so copies cost nothing further.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.hot_join import join_facts
from tarnwork.plans.components import connected_components
from tarnwork.plans.shared import written

MAX_BITS = 4
SHINGLE_WORDS = 4
#: Rows that share one key beyond this many go the way of ``midpoint_links``.
BUCKET_ROWS = 4096
#: Fingerprints whose keys (about 170 each) are emitted in one task, at most about.
EMIT_ROWS = 10_000

_POLY = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code
_WIDTHS = (22, 21, 21)
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set where over half of the hashes have them set."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256) @ _BIT
    return int(np.packbits((2 * seen > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def simhash64(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of lower-cased (A-Z) text: bit i is set if it is set in over half of its shingles' XXH64 (seed 42).

    Words are separated by ASCII white space; shingles count as often as they occur. Fewer words than a shingle has
    make one shingle; none make fingerprint 0.
    """
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), 42)
    joined = b" ".join(parts)
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[: len(parts) - words]]
    return majority(np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :])], np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([simhash64(t.as_py()) for t in b.column(1)], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def _syndrome(v: np.ndarray) -> np.ndarray:
    for i in range(22, 10, -1):
        v = np.where((v >> i) & 1, v ^ (_POLY << (i - 11)), v)
    return v


def _key_table() -> np.ndarray:
    """For each of the 2,048 syndromes, the error patterns that lead to a codeword within distance 4; -1 fills up."""
    table, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in c) for c in itertools.combinations(range(23), weight)], np.int64)
        for e, s in zip(errors, _syndrome(errors), strict=True):
            table[s, filled[s]] = e
            filled[s] += 1
    return table


_TABLE = _key_table()


def segments(fp: np.ndarray) -> list[np.ndarray]:
    u, out = fp.view(np.uint64), []
    for width in _WIDTHS:
        out.append((u & np.uint64((1 << width) - 1)).astype(np.int64))
        u = u >> np.uint64(width)
    return out


def segment_keys(segment: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each segment, six columns; -1 fills up."""
    errors = _TABLE[_syndrome(segment)]
    return np.where(errors >= 0, (segment[:, None] ^ errors) >> 11, -1)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every key of every fingerprint; the top bits of a key name its kind."""
    parts = segments(fp)
    keys = [segment_keys(s) for s in parts]
    rows, out = [], []
    a, b, c = keys[0][:, :, None, None], keys[1][:, None, :, None], keys[2][:, None, None, :]
    ok = (a >= 0) & (b >= 0) & (c >= 0)
    rows.append(np.nonzero(ok)[0])
    out.append(((a << 24) | (b << 12) | c)[ok])
    for kind, (whole, near) in enumerate(itertools.permutations(range(3), 2), 1):
        ok = keys[near] >= 0
        rows.append(np.nonzero(ok)[0])
        out.append((np.int64(kind) << 40) | ((parts[whole][:, None] << 12) | keys[near])[ok])
    return np.concatenate(rows), np.concatenate(out)


def _shared_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The one key that stands for each pair: the smallest triple they share, else the smallest shared pair."""
    big = np.int64(1) << 60
    px, py = segments(x), segments(y)
    least = []
    for sx, sy in zip(px, py, strict=True):
        kx, ky = segment_keys(sx), segment_keys(sy)
        same = (kx[:, :, None] == ky[:, None, :]) & (kx[:, :, None] >= 0)
        least.append(np.where(same, kx[:, :, None], big).min(axis=(1, 2)))
    found = np.where((least[0] < big) & (least[1] < big) & (least[2] < big), (least[0] << 24) | (least[1] << 12) | least[2], big)
    for kind, (whole, near) in enumerate(itertools.permutations(range(3), 2), 1):
        ok = (px[whole] == py[whole]) & (least[near] < big) & (found == big)
        found = np.where(ok, (np.int64(kind) << 40) | (px[whole] << 12) | np.where(ok, least[near], 0), found)
    return found


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of these links, enough to hold together what they connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(every), 500):
            fp = every[at : at + 500]
            row, key = golay_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def _links_of(key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Verified links within runs of equal keys; a pair that shares several keys counts at one of them only."""
    xs, ys = [], []
    at = np.arange(len(key))
    for shift in range(1, len(key)):
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        if not len(at):
            break
        near = np.bitwise_count((fp[at] ^ fp[at + shift]).view(np.uint64)) <= MAX_BITS
        hit = at[near]
        if len(hit):
            hit = hit[_shared_key(fp[hit], fp[hit + shift]) == key[hit]]
            xs.append(fp[hit])
            ys.append(fp[hit + shift])
    return _spanning(np.concatenate(xs), np.concatenate(ys)) if xs else []


def _link_buckets(bucket_rows: int):
    """Reads rows sorted by key; yields (a, b) for links, (a, null) for each row of a bucket that is too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: list[int], b: list[int | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        large: int | None = None  # the key whose rows are passed on
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
                fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False)])
                if large is not None:
                    same = int(np.searchsorted(key, large, "right"))
                    if same:
                        yield out(fp[:same].tolist(), [None] * same)
                    key, fp = key[same:], fp[same:]
                    if not len(key):
                        held_key, held_fp = key, fp
                        continue
                    large = None
                cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
                if len(key) - cut > bucket_rows:  # the last key may go on, and is too large already
                    large = int(key[-1])
                    yield out(fp[cut:].tolist(), [None] * (len(key) - cut))
                    held_key, held_fp = key[:0], fp[:0]
                else:
                    held_key, held_fp = key[cut:], fp[cut:]
                key, fp = key[:cut], fp[:cut]
            else:
                key, fp = held_key, held_fp
            if not len(key):
                continue
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[first, len(key)])
            over = np.repeat(sizes > bucket_rows, sizes)
            if over.any():
                yield out(fp[over].tolist(), [None] * int(over.sum()))
                key, fp = key[~over], fp[~over]
            links = _links_of(key, fp)
            if links:
                yield out([x for x, _ in links], [y for _, y in links])

    return run


_MASKS = np.array([0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)], np.uint64).astype(np.int64)


def _emit_midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(every), 50):
            fp = every[at : at + 50]
            yield pa.RecordBatch.from_arrays(
                [pa.array((fp[:, None] ^ _MASKS).ravel()), pa.array(np.repeat(fp, len(_MASKS)))], ["z", "fp"]
            )


def midpoint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect what lies within 4 bits, however many fingerprints stand close together.

    Two fingerprints differ in 4 bits or fewer exactly if some 64-bit value is within 2 bits of both, so all that
    share such a value are linked to the least of them: 2,081 rows a fingerprint, and no pair is ever formed.
    """
    near = fps.mapInArrow(_emit_midpoints, "z long, fp long")
    least = near.groupBy("z").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").select("z", "b")
    return near.join(least, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of column ``fp`` that connect all within 4 bits of each other."""
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() // EMIT_ROWS))
    spread = fps.select("fp").repartition(tasks, "fp")
    keyed = spread.mapInArrow(_emit_keys, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = written(keyed.mapInArrow(_link_buckets(bucket_rows), "a long, b long"), "links")
    links, crowded = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("fp")).distinct()
    return links if crowded.isEmpty() else links.unionByName(midpoint_links(crowded))


def simhash_components(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (long), component_id.

    Documents are linked if their fingerprints differ in 4 bits or fewer; component_id is the smallest doc_id
    reachable by links, itself included. Null and empty texts have fingerprint 0 and are linked like any other.
    A null doc_id takes part, but is no component_id unless a component has no other. Repeated rows stay repeated.
    Other columns are ignored; no rows give no rows.
    """
    prints = written(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "fingerprints")
    groups = connected_components(near_links(distinct, bucket_rows), "a", "b")
    joined = groups.withColumnRenamed("node", "fp").join(distinct, "fp")
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = groups.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n")
    return join_facts(prints, written(named, "named"), "fp", "n").select("doc_id", "fp", "component_id")


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

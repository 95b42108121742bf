"""N-gram Jaccard join by vertical partitioning: sets of 5-word shingles of similarity 0.8 or more.

All shingles of the corpus stand in one order, the rarer first. The order is cut into ``FRAGMENTS`` pieces of equal
weight, and so is every set: a fragment of it holds its shingles of that piece. Overlaps of two sets are counted in
each fragment on its own, by whichever task has that fragment, and summed for each pair; no task needs two whole sets.

Counts come from a pass over all documents that adds up ``CELLS`` counters, each of a share of all shingles by their
hash. A crowded counter makes a rare shingle look frequent, which costs time and never a pair: any order is right.

Pairs to count are those that share one of the first shingles in the order: two sets of similarity s share one among
the first n - ceil(s n) + 1 of each. A group of k near copies has k^2 / 2 such pairs, which are not formed. Documents
are reduced to distinct sets first. Where more than a few sets share a shingle, they are counted against one of them;
members that are still outside the largest component of that shingle, against a few of its members; and what is then
in different components of one shingle, pair by pair, in blocks of bounded size. So every link is found or connected
by others. Frequent shingles are dealt over several tasks at each of these steps. Before pairs of such shingles are
counted they are held against each other by bitmaps: a bit says whether an odd number of a set's shingles falls on it,
so the number of bits in which two differ is at most the number of shingles that only one of them has. A few hundred
bits tell nothing of two large sets, so those have bitmaps that grow with them, and pairs pass these before their
shingles are fetched: only sets that are in a pair left by then are moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.hot_join import join_facts
from tarnwork.plans.components import connected_components
from tarnwork.plans.shared import written

WORDS = 5
#: Least similarity, as a fraction.
SIMILAR = (8, 10)
FRAGMENTS = 8
#: Counters of shingles, a power of two, and how many of them a row holds.
CELLS, CELL_ROW = 1 << 21, 1 << 14
#: A shingle whose counter is above this, and above 8 times the mean, is dealt over several tasks.
HEAVY = 500
#: Sets that share one shingle beyond this many are compared with one of them first; those still apart from the
#: largest component, with ``PIVOTS`` of its members; then in blocks of about ``BLOCK`` members.
BUCKET_ROWS, PIVOTS, BLOCK = 4, 4, 512
#: Rows of one shingle that a task holds at a time.
HELD_ROWS = 200_000
#: Ids of sets, of a few numbers each, that are sent to all tasks at most; more are joined by a shuffle.
SENT_ROWS = 1_000_000
#: Bits of a set's bitmap; a larger set also has a wide one, with at least a bit for each of its shingles.
BITS = 512

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words of lower-cased (A-Z) text; fewer words make one run."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    words = np.fromiter(map(digest, parts), np.uint64, len(parts))
    width = min(WORDS, len(parts))
    runs = len(parts) - width + 1
    h = np.full(runs, width, np.uint64)
    for i in range(width):
        h = h + words[i : i + runs] * _MIX[i]
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return np.unique(h ^ (h >> np.uint64(29)))


def prefix_size(n: int) -> int:
    """So many first shingles of a set of n hold one of those it shares with any similar set."""
    return n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1


def similar(shared, n, m):
    """Whether so many shared shingles make sets of n and m similar."""
    return shared * (SIMILAR[0] + SIMILAR[1]) >= (n + m) * SIMILAR[0]


def possible(n, p, m, q):
    """Sizes n, m and places p, q (from 0) of the first shingle two sets share leave room for enough shared ones."""
    return similar(1 + np.minimum(n - p - 1, m - q - 1), n, m)


def bitmap(shingles: np.ndarray, size: int = BITS) -> bytes:
    return np.packbits(np.bincount((shingles % np.uint64(size)).astype(np.int64), minlength=size) & 1).tobytes()


def wide_bitmap(shingles: np.ndarray) -> bytes:
    """Of a power of two of bits, so that the halves of a larger one make a smaller one; empty for small sets."""
    return bitmap(shingles, 1 << (len(shingles) - 1).bit_length()) if len(shingles) > BITS else b""


def alike(x, y, n, m):
    """Whether sets of n and m shingles with these bitmaps may share enough."""
    least = -(-(n + m) * SIMILAR[0] // (SIMILAR[0] + SIMILAR[1]))
    return np.bitwise_count(x ^ y).sum(-1) <= n + m - 2 * least


def alike_wide(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether sets of n and m shingles with these wide bitmaps may share enough."""
    if not x or not y:
        return True
    x, y = (np.frombuffer(c, np.uint64) for c in (x, y))
    while len(x) != len(y):
        x, y = sorted((x, y), key=len)
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return bool(alike(x, y, n, m))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of a task's texts, in rows of ``CELL_ROW``; rows of zeros are left out."""
    total, held, size = np.zeros(CELLS, np.int64), [], 0
    for b in batches:
        for t in b.column(0):
            held.append(_cell(shingle_set(t.as_py())).astype(np.int32))
            size += len(held[-1])
            if size > CELLS // 4:
                total += np.bincount(np.concatenate(held), minlength=CELLS)
                held, size = [], 0
    total += np.bincount(np.concatenate([*held, np.empty(0, np.int32)]), minlength=CELLS)
    for at, row in enumerate(total.reshape(-1, CELL_ROW)):
        if row.any():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_pressed(row)], pa.binary())], ["at", "counts"])


def _pressed(row: np.ndarray) -> bytes:
    return zlib.compress(row.astype(np.int32 if row.max() < 1 << 31 else np.int64).tobytes(), 1)


def _unpressed(row: bytes) -> np.ndarray:
    plain = zlib.decompress(row)
    return np.frombuffer(plain, np.int32 if len(plain) == 4 * CELL_ROW else np.int64).astype(np.int64)


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(CELL_ROW, np.int64)
    for row in table.column("counts"):
        total += _unpressed(row.as_py())
    return pa.table([table.column("at")[:1], pa.array([_pressed(total)], pa.binary())], ["at", "counts"])


class Order:
    """The global order of shingles: by the count of their cell, then the cell, then their hash; and its fragments."""

    def __init__(self, counts: np.ndarray):
        by = np.argsort(counts, kind="stable").astype(np.int32)
        self.rank = np.empty(len(counts), np.int32)
        self.rank[by] = np.arange(len(counts), dtype=np.int32)
        rising = counts[by]
        del by
        weight = np.cumsum(rising)
        self.cuts = np.searchsorted(weight, weight[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS).astype(np.int32)
        limit = max(HEAVY, 8 * int(weight[-1]) // len(counts))
        self.first_heavy = int(np.searchsorted(rising, limit, "right"))  # ranks from here on are heavy
        self.parts = np.minimum(rising[self.first_heavy :] // limit + 1, 1 << 20).astype(np.int32)

    def sorted(self, shingles: np.ndarray) -> np.ndarray:
        return shingles[np.lexsort((shingles, self.rank[_cell(shingles)]))]

    def fragments(self, ordered: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Fragment number and shingles, of each fragment that an ordered set has."""
        at = np.searchsorted(self.rank[_cell(ordered)], self.cuts, "right")
        return [(i, part) for i, part in enumerate(np.split(ordered, at)) if len(part)]

    def salts(self, h: np.ndarray, set_id: int) -> np.ndarray:
        """0 for light shingles, else one of the parts (from 1) over which the shingle is dealt."""
        rank, out = self.rank[_cell(h)], np.zeros(len(h), np.uint64)
        heavy = np.flatnonzero(rank >= self.first_heavy)
        if len(heavy):
            drawn = (h[heavy] ^ (np.array([set_id], np.uint64) * _MIX[1])) * _MIX[2] >> np.uint64(20)
            out[heavy] = 1 + drawn % self.parts[rank[heavy] - self.first_heavy].astype(np.uint64)
        return out


def global_order(rows: DataFrame) -> Order:
    """The order of the shingles of all texts."""
    found = rows.select("text").mapInArrow(_count_cells, "at int, counts binary").withColumn("__salt", F.spark_partition_id() % 64)
    for keys in (("at", "__salt"), ("at",)):  # many tasks' counters are added up in two steps
        found = found.groupBy(*keys).applyInArrow(_added, "at int, counts binary")
        if len(keys) == 2:
            found = found.withColumn("__salt", F.lit(0))
    counts = np.zeros((CELLS // CELL_ROW, CELL_ROW), np.int64)
    for at, row in found.select("at", "counts").toLocalIterator():
        counts[at] = _unpressed(bytes(row))
    return Order(counts.ravel())


#: What tells rows apart: rows with an id come before rows without.
KEY = ("no_id", "id", "text_hash")


def keys() -> list[Column]:
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash")]


def _prints(order, more: Callable[[np.ndarray], int] | None):
    """Reads no_id, id, text_hash, text; of each the set's digest, size, first shingles and bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                digests, sizes, prefixes, bits, wide, extra = [], [], [], [], [], []
                for t in b.column(3):
                    s = shingle_set(t.as_py())
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    prefixes.append(order.value.sorted(s)[: prefix_size(len(s))].tobytes() if len(s) else b"")
                    bits.append(bitmap(s))
                    wide.append(wide_bitmap(s))
                    extra.append(more(s) if more and len(s) else 0)
                fp = pa.array(np.array(extra, np.uint64).astype(np.int64))
                columns = [*b.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), fp]
                yield pa.RecordBatch.from_arrays(columns, [*KEY, "digest", "n", "prefix", "bits", "wide", "fp"])

    return run


def distinct_sets(rows: DataFrame, order, more: Callable[[np.ndarray], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Prints of all rows (no_id, id, text_hash, text), and of each distinct set its set_id, first row and count of rows.

    Sets are equal if the 128-bit digests of their shingles are. ``more`` makes a fingerprint ``fp`` of a set.
    """
    schema = "no_id boolean, id long, text_hash long, digest binary, n long, prefix binary, bits binary, wide binary, fp long"
    prints = written(rows.mapInArrow(_prints(order, more), schema), "prints")
    found = prints.groupBy("digest").agg(F.min(F.struct(*KEY)).alias("row"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits", "wide", "fp")], F.count("*").alias("rows"))
    # numbered where they are written, once
    return prints, written(found.select(F.monotonically_increasing_id().alias("set_id"), "digest", "row.*", "n", "prefix", "bits", "wide", "fp", "rows"), "sets")


def _emit_prefixes(order, heavy: bool):
    """First shingles of sets. With ``heavy``, only those of heavy cells: h, set_id, n, place. Else all, in two numbers
    and a key: that of a heavy shingle is one of its parts'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                keys, ids, sizes, places, flags = [], [], [], [], []
                for set_id, n, prefix in zip(*(b.column(i).slice(at, 500).to_pylist() for i in range(3)), strict=True):
                    h = np.frombuffer(prefix, np.uint64)
                    salt = order.value.salts(h, set_id)
                    on = np.flatnonzero(salt) if heavy else np.arange(len(h))
                    if not len(on):
                        continue
                    keys.append(h[on] if heavy else np.where(salt > 0, (h ^ salt) * _MIX[3], h))
                    ids.append(np.full(len(on), set_id))
                    sizes.append(np.full(len(on), n))
                    places.append(on)
                    flags.append(salt[on] > 0)
                if not keys:
                    continue
                k, i, n, p, f = (np.concatenate(c) for c in (keys, ids, sizes, places, flags))
                k = pa.array(k.view(np.int64))
                if heavy:
                    yield pa.RecordBatch.from_arrays([k, pa.array(i), pa.array(n), pa.array(p)], ["h", "set_id", "n", "place"])
                else:
                    yield pa.RecordBatch.from_arrays([k, pa.array(i), pa.array(n << 32 | p << 1 | f)], ["h", "set_id", "facts"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], most: int = HELD_ROWS) -> Iterator[list[np.ndarray]]:
    """Columns of consecutive rows, cut only where the first column changes, or where it is the same in ``most`` rows."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        full = sum(len(c[0]) for c in held) >= most
        if held and (cut or full or held[-1][0][-1] != now[0][-1]):
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in now], strict=True)]
            held = []
        elif cut:
            yield [c[:cut] for c in now]
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _batch(a, b, rows=None) -> pa.RecordBatch:
    """Candidates (a, b), or with ``rows`` members of a crowded shingle, which have no b."""
    none = pa.nulls(len(a), pa.int64())
    h, n, place = (none, none, none) if rows is None else (pa.array(r) for r in rows)
    return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), h, n, place], ["a", "b", "h", "n", "place"])


def _candidates(bucket_rows: int):
    """Reads rows sorted by shingle: all candidates of small buckets; of others those with one of them, and every member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, ids, facts in _runs(batches):
            n, place, heavy = facts >> 32, facts >> 1 & 0x7FFFFFFF, facts & 1
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sizes = np.diff(np.r_[first, len(h)])
            size = np.repeat(sizes, sizes)
            at = np.flatnonzero((size > 1) & (size <= bucket_rows))
            for shift in range(1, bucket_rows):
                at = at[at + shift < len(h)]
                at = at[h[at] == h[at + shift]]
                if not len(at):
                    break
                to = at + shift
                ok = possible(n[at], place[at], n[to], place[to]) & (ids[at] != ids[to])
                if ok.any():
                    yield _batch(ids[at[ok]], ids[to[ok]])
            big = sizes > bucket_rows
            member = np.repeat(big, sizes)
            if not big.any():
                continue
            told = member & (heavy == 0)  # members of heavy shingles are told in a pass of their own
            yield _batch(ids[told], None, (h[told], n[told], place[told]))
            pivot = np.repeat(first + (h.view(np.uint64)[first] >> np.uint64(7)) % sizes.astype(np.uint64), sizes).astype(np.int64)
            ok = member & possible(n, place, n[pivot], place[pivot]) & (ids != ids[pivot])
            yield _batch(ids[ok], ids[pivot[ok]])

    return run


def _bits(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b with their sizes, bitmaps and wide bitmaps; those that may be similar, with their sizes."""
    for b in batches:
        n, m, x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns[2:6])
        if len(n):
            few = b.filter(pa.array(alike(_bits(x), _bits(y), n, m)))
            ok = [alike_wide(*facts) for facts in zip(*(few.column(i).to_pylist() for i in (6, 7, 2, 3)), strict=True)]
            yield few.select(["a", "b", "n_a", "n_b"]).filter(pa.array(ok, pa.bool_()))


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their sizes, places and bitmaps; those that may be similar."""
    for b in batches:
        a, n, p, x, to, m, q, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if len(a):
            ok = possible(n, p, m, q) & alike(_bits(x), _bits(y), n, m)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(to[ok])], ["a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads block pairs (key, side, set_id, n, place, component, bits) sorted by key: candidates of side 0 and any member."""
    for columns in _runs(batches):
        edges = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1], True])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            _, side, ids, n, place, component, bits = (c[lo:hi] for c in columns)
            bits = _bits(bits)
            for x in np.flatnonzero(side == 0):
                ok = (component != component[x]) & possible(n, place, n[x], place[x]) & alike(bits, bits[x], n, n[x])
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), ids[x])), pa.array(ids[ok])], ["a", "b"])


def _emit_fragments(order):
    """Reads set_id and text; the fragments of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                ids, parts = [], []
                for w, t in zip(b.column(0).slice(at, 100).to_pylist(), b.column(1).slice(at, 100), strict=True):
                    found = order.value.fragments(order.value.sorted(shingle_set(t.as_py())))
                    ids += [w] * len(found)
                    parts += found
                if parts:
                    offsets = np.cumsum([0, *(len(p) for _, p in parts)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p for _, p in parts]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([i for i, _ in parts], pa.int32()), lists], ["set_id", "fragment", "shingles"])

    return run


def _sent(ids: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast where it is small enough."""
    return F.broadcast(ids) if ids.count() <= SENT_ROWS else ids


def fragments_of(needed: DataFrame, leaders: DataFrame, rows: DataFrame, order) -> DataFrame:
    """set_id, fragment and shingles of the needed sets, from the text of the first row of each."""
    firsts = written(needed.distinct().join(leaders.select("set_id", *KEY), "set_id"), "needed")
    texts = rows.join(_sent(firsts), list(KEY)).select("set_id", "text")
    return written(texts.mapInArrow(_emit_fragments(order), "set_id long, fragment int, shingles array<long>").dropDuplicates(["set_id", "fragment"]), "fragments")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()


def likely(candidates: DataFrame, leaders: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The distinct candidates (a, b), the smaller id first, that pass their bitmaps, with n_a and n_b.

    With ``groups`` (set_id, component) only those whose ends are not in one group: what is connected is not counted again.
    """
    pairs = written(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    known = leaders.join(_sent(written(_ends(pairs), "ends")), "set_id", "left_semi")
    facts = ["n", "bits", "wide"]
    if groups is not None:
        known, facts = known.join(_sent(groups), "set_id", "left"), [*facts, "component"]
    side = lambda end: known.select(F.col("set_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in facts])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    if groups is not None:
        both = both.where("component_a is null or component_b is null or component_a <> component_b")
    both = both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b", "wide_a", "wide_b")
    return written(both.mapInArrow(_maybe, "a long, b long, n_a long, n_b long"), "likely")


def linked(pairs: DataFrame, leaders: DataFrame, rows: DataFrame, order) -> DataFrame:
    """The likely pairs whose sets are similar, as (a, b): overlaps are counted by fragment and summed for each pair."""
    parts = fragments_of(_ends(pairs), leaders, rows, order)
    side = lambda end: parts.select(F.col("set_id").alias(end), "fragment", F.col("shingles").alias(f"of_{end}"))
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).alias("shared"))
    summed = met.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return written(summed.where(similar(F.col("shared"), F.col("n_a"), F.col("n_b"))).select("a", "b"), "links")


def _apart(crowded: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the crowded shingles whose sets are in several components, with ``outside`` the largest of the shingle.

    And these shingles, with the count of their members inside and outside.
    """
    members = crowded.join(groups, "set_id", "left").withColumn("component", F.coalesce("component", -1 - F.col("set_id")))
    counts = members.groupBy("h", "component").count()
    tops = counts.groupBy("h").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("members"))
    tops = written(tops.where("top.count < members").select("h", "members", F.col("top.component").alias("largest"), F.col("top.count").alias("inside")), "mixed-shingles")
    found = join_facts(members, tops.withColumn("all", F.col("members")), "h", "all")
    return written(found.withColumn("outside", F.col("component") != F.col("largest")), "members"), tops


def _with_pivots(members: DataFrame, tops: DataFrame) -> DataFrame:
    """Candidates of members outside and a few inside."""
    one = F.struct("set_id", "n", "place", "bits")
    pivots = members.where("not outside").groupBy("h").agg(*[F.min_by(one, F.xxhash64("set_id", "h", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)])
    facts = tops.select("h", (F.col("members") - F.col("inside")).alias("k")).join(pivots, "h").select("h", "k", F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("pivots"))
    met = join_facts(members.where("outside").select("h", "set_id", "n", "place", "bits"), written(facts, "pivots"), "h", "k")
    met = met.select("set_id", "n", "place", "bits", F.explode("pivots").alias("p")).select("set_id", "n", "place", "bits", "p.set_id", "p.n", "p.place", "p.bits")
    return met.toDF("a", "n", "p", "x", "b", "m", "q", "y").mapInArrow(_against, "a long, b long")


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Candidates of members outside and all others of another component, in pairs of blocks."""
    blocks = lambda count: F.ceil(count / block)
    out_blocks, in_blocks = blocks(F.col("members") - F.col("inside")), blocks(F.col("inside"))
    own = F.pmod(F.xxhash64("set_id"), F.when(F.col("outside"), out_blocks).otherwise(in_blocks)).cast("int")
    placed = members.withColumns({"own": own, "out_blocks": out_blocks.cast("int"), "in_blocks": in_blocks.cast("int")})
    # a pair of blocks is (left, right, whether right is outside); side 0 are the members of left
    as_left = placed.where("outside").select("*", F.explode(F.expr("concat(transform(sequence(own, out_blocks - 1), r -> struct(own as l, r as r, true as o, 0 as side)), transform(sequence(0, in_blocks - 1), r -> struct(own as l, r as r, false as o, 0 as side)))")).alias("at"))
    as_right = placed.where("outside and own > 0").select("*", F.explode(F.expr("transform(sequence(0, own - 1), l -> struct(l as l, own as r, true as o, 1 as side))")).alias("at"))
    inside = placed.where("not outside").select("*", F.explode(F.expr("transform(sequence(0, out_blocks - 1), l -> struct(l as l, own as r, false as o, 1 as side))")).alias("at"))
    rows = as_left.unionByName(as_right).unionByName(inside)
    rows = rows.select(F.xxhash64("h", "at.l", "at.r", "at.o").alias("k"), "at.side", "set_id", "n", "place", "component", "bits")
    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(_across, "a long, b long")


def set_groups(rows: DataFrame, leaders: DataFrame, order, near: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS, block: int = BLOCK) -> DataFrame:
    """set_id and component (a set_id) of the sets that are linked with any other.

    ``near`` has the set_id and component of sets that links found elsewhere connect; pairs inside these are not counted.
    """
    some = leaders.where("n > 0").select("set_id", "n", "prefix")
    schema = "a long, b long, h long, n long, place long"
    keyed = some.mapInArrow(_emit_prefixes(order, False), "h long, set_id long, facts long")
    found = written(keyed.repartition("h").sortWithinPartitions("h").mapInArrow(_candidates(bucket_rows), schema), "buckets")
    heavy = some.mapInArrow(_emit_prefixes(order, True), "h long, set_id long, n long, place long")
    first = found.where("b is not null").select("a", "b")
    crowded = heavy.unionByName(found.where("b is null").select("h", F.col("a").alias("set_id"), "n", "place"))
    crowded = written(crowded.join(leaders.select("set_id", "bits"), "set_id"), "crowded")
    links = linked(likely(first, leaders, near), leaders, rows, order)
    if near is not None:
        links = links.unionByName(near.select(F.col("set_id").alias("a"), F.col("component").alias("b")))
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "set_id")
    for last in (False, True):
        members, tops = _apart(crowded, groups)
        if tops.isEmpty():
            break
        pairs = likely(_in_blocks(members, block) if last else _with_pivots(members, tops), leaders)
        rest = linked(pairs, leaders, rows, order)
        if not rest.isEmpty():
            links = links.unionByName(rest)
            groups = connected_components(links, "a", "b").withColumnRenamed("node", "set_id")
    return groups


def similar_components(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles (long) and component_id of each row: the smallest doc_id that links reach, its own included.

    Texts that are null or have no words have no shingles and are linked with nothing. Rows with a null id take part:
    their doc_id stays null, and so does the component_id where no row reached has an id. Rows that share an id are
    linked by their texts alone. Repeated rows stay. No rows give no rows; other columns are ignored.
    """
    rows = docs.select(*keys(), "text")
    order = docs.sparkSession.sparkContext.broadcast(global_order(rows))
    prints, leaders = distinct_sets(rows, order)
    groups = set_groups(rows, leaders, order, None, bucket_rows, block)
    named = written(leaders.select("set_id", "digest", "no_id", "id", "rows").join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "named-sets")
    least = named.groupBy("component").agg(F.min(F.struct("no_id", "id")).alias("least"))
    facts = written(named.join(least, "component").select("digest", F.when(~F.col("least.no_id"), F.col("least.id")).alias("least"), "rows"), "facts")
    own = F.when(~F.col("no_id"), F.col("id"))
    out = join_facts(prints.select("no_id", "id", "n", "digest"), facts, "digest", "rows")
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(own).alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the size of their sets of 5-word shingles and their components at a similarity of 0.8."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

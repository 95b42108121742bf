"""Sharding by a Hilbert curve over quantised metadata.

Each row becomes a cell of an n-dimensional grid; the cell's place on a Hilbert curve orders the rows, and equal
runs of that order become shards. Rows that are near in several columns at once share shards, so the minimum and
maximum of each column in a shard's files prune reads on any of them.

Only DataFrame functions are used. The curve index is a fold over bit planes with a small state table; the global
rank comes from bucket counts and a row number inside each bucket, never from one sorted task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm.hot_join import join_facts
from tarnwork.plans.shared import written

N_SHARDS = 8
BITS = 5
#: Bits of the hashes that order rows of one cell; two of them and the curve index fit in 63 bits.
_HASH_BITS = 20


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) for each state and corner of the n-dimensional curve.

    A state is an entry corner e and a direction d. Corners are met in Gray-code order, turned so that they begin at
    e along d; each sub-cube starts where the last one ended.
    """
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    place = {g: i for i, g in enumerate(gray)}

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & full

    def ones(x: int) -> int:  # trailing set bits
        k = 0
        while x & 1:
            x, k = x >> 1, k + 1
        return k

    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(1 << n)]
    along = [0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n for w in range(1 << n)]
    digit, after = [], []
    for e in range(1 << n):
        for d in range(n):
            for corner in range(1 << n):
                w = place[turn(corner ^ e, n - (d + 1) % n)]
                digit.append(w)
                after.append((e ^ turn(entry[w], d + 1)) * n + (d + along[w] + 1) % n)
    return digit, after


def curve_index(dims: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve, as a long, of a cell whose coordinates are integers from 0 to 2^bits - 1."""
    n = len(dims)
    digit, after = (F.array(*map(F.lit, t)) for t in curve_tables(n))

    def step(acc: Column, level: Column) -> Column:
        corner = F.lit(0)
        for j, x in enumerate(dims):
            corner = corner.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", x, level).bitwiseAND(F.lit(1)), F.lit(j)))
        at = acc["s"] * F.lit(1 << n) + corner + F.lit(1)
        return F.struct(
            (acc["h"] * F.lit(1 << n) + F.element_at(digit, at)).cast("long").alias("h"),
            F.element_at(after, at).cast("int").alias("s"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("int").alias("s"))
    levels = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(levels, start, step, lambda a: a["h"])


def _below(bounds: list, value: Column, kind: str) -> Column:
    """How many of the sorted bounds are at most ``value``; nulls count as below all."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b).cast(kind) for b in bounds])
    return F.when(value.isNull(), F.lit(0)).otherwise(F.size(F.filter(cuts, lambda b: b <= value)))


def _with_category(base: DataFrame, name: str, cells: int, out: str) -> DataFrame:
    """``base`` with a column's place from 0 to cells - 1, in the order of values so that a cell is a range of them.

    A value stands where its middle row stands among all rows; no more values than cells stand at equal distances. Null
    counts as an empty text. Values are ranked by sorting the distinct ones by range and adding up their counts.
    """
    text = F.coalesce(F.col(name).cast("string"), F.lit("")).alias("__v")
    ranges = written(base.groupBy(text).count().repartitionByRange("__v").withColumn("__range", F.spark_partition_id()), "values")
    sums = ranges.groupBy("__range").agg(F.sum("count").alias("rows"), F.count("*").alias("values"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select("__range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("values").over(before), F.lit(0)).alias("values_before"))
    n = ranges.agg(F.sum("count").alias("rows"), F.count("*").alias("values")).first()
    inside = Window.partitionBy("__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    at = ranges.join(sums, "__range").withColumns({
        "rows_before": F.col("rows_before") + F.coalesce(F.sum("count").over(inside), F.lit(0)),
        "values_before": F.col("values_before") + F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1,
    })
    few = n["values"] <= cells
    place = f"values_before * {cells} div {max(n['values'], 1)}" if few else f"(rows_before + count div 2) * {cells} div {n['rows']}"
    facts = written(at.select("__v", "count", F.expr(place).cast("int").alias(out)), "places")
    return join_facts(base.withColumn("__v", text), facts, "__v", "count").drop("__v")


def hilbert_shards(rows: DataFrame, categories: list[str], measures: list[str], n_shards: int = N_SHARDS, bits: int = BITS, group: list[str] | None = None) -> DataFrame:
    """Add ``curve`` (long), ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in its shard) to ``rows``.

    Rows are cut into ``n_shards`` runs of the curve whose counts differ by one at most.

    categories: columns that have a text form, placed in the order of values (null counts as an empty text). measures:
    numeric columns, null ids among them, placed by approximate quantiles (null counts as below all). Rows that agree
    in ``group`` stand together at the first place that any of them has on the curve, so at most one group is cut by
    each border of shards. Columns named like the added ones are replaced. No rows give no rows. Rows in one cell are
    ordered by a hash of their group and then of all columns, and repeated rows take different slots. The rows are
    written once to the shared folder, so ``rows`` should hold metadata only.
    """
    if (len(categories) + len(measures)) * bits + _HASH_BITS * (2 if group else 1) > 63:
        raise ValueError("the curve has too many bits; take fewer columns or bits")
    spark = rows.sparkSession
    rows = rows.drop("curve", "shard", "slot")
    names = rows.columns
    base = written(rows.select("*", F.monotonically_increasing_id().alias("__row")), "metadata")
    cells = 1 << bits
    inner = [i / cells for i in range(1, cells)]
    facts = base.agg(
        F.count("*").alias("n"),
        *[F.percentile_approx(m, inner, 20_000).alias(f"q{i}") for i, m in enumerate(measures)],
    ).first()
    total = facts["n"]
    for i, c in enumerate(categories):
        base = _with_category(base, c, cells, f"__c{i}")
    dims = [F.col(f"__c{i}") for i in range(len(categories))]
    dims += [
        _below(sorted(facts[f"q{i}"] or []), F.col(m).cast("double"), "double").cast("int")
        for i, m in enumerate(measures)
    ]
    placed = base.select("*", *[d.alias(f"__x{i}") for i, d in enumerate(dims)])
    placed = placed.withColumn("curve", curve_index([F.col(f"__x{i}") for i in range(len(dims))], bits))
    hashed = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit((1 << _HASH_BITS) - 1))
    order = F.shiftleft("curve", _HASH_BITS)
    if group:
        placed = written(placed.withColumn("__group", F.struct(*group)), "on-curve")
        firsts = written(placed.groupBy("__group").agg(F.min("curve").alias("__first"), F.count("*").alias("__k")), "groups")
        placed = join_facts(placed, firsts, "__group", "__k").withColumn("curve", F.col("__first")).drop("__first")
        order = F.shiftleft(order.bitwiseOR(hashed("__group")), _HASH_BITS)
    # hashes below the curve index let buckets cut through a cell, or a group, with very many rows
    placed = placed.withColumn("__order", order.bitwiseOR(hashed(*names, "__row"))).drop("__group", *[f"__x{i}" for i in range(len(dims))])
    n_buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = placed.agg(F.percentile_approx("__order", [i / n_buckets for i in range(1, n_buckets)], 20_000).alias("q")).first()["q"]
    placed = placed.withColumn("__bucket", _below(sorted(set(cuts or [])), F.col("__order"), "long"))
    before, starts = 0, {}
    for b, k in sorted((r["__bucket"], r["count"]) for r in placed.groupBy("__bucket").count().collect()):  # at most n_buckets rows
        starts[b], before = before, before + k
    start = F.element_at(F.create_map(*[F.lit(x) for b, s in starts.items() for x in (b, s)]), F.col("__bucket")) if starts else F.lit(0)
    in_bucket = F.row_number().over(Window.partitionBy("__bucket").orderBy("__order", "__row"))
    n, k = F.lit(max(total, 1)).cast("long"), F.lit(n_shards).cast("long")
    ranked = placed.withColumn("__rank", start.cast("long") + in_bucket - 1)
    ranked = ranked.withColumn("shard", F.expr(f"cast((__rank * {n_shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("slot", F.col("__rank") - first).select(*names, "curve", "shard", "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """Write sharded rows to one folder for each shard, in slot order, so that files carry tight column ranges."""
    rows.repartitionByRange("shard", "curve").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, size (UTF-8 bytes of the text plus 1; null: 1) and text_crc32 (null text: that of no bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        "source",
        "lang",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards along a curve over source, language, size and id, equal texts together. Law: rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = hilbert_shards(document_metadata(docs), ["source", "lang"], ["size", "doc_id"], group=["text_crc32", "size"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )

"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Each shingle is hashed once: seven bits choose one of 128 bins, the rest is its value, and a bin keeps its least
value. An empty bin borrows from a filled one: every empty bin orders all bins by a hash of the two bin numbers and
takes the first filled one in that order, which draws a filled bin uniformly and, for two sets, the same one whenever
both have it. Eight low-order bits of each bin are stored; since unequal bins agree in them once in 256, likeness is
corrected for that.

All of it is built from SQL functions. The next document of each document comes from buckets of the id range: each
bucket also gets the first document of the next bucket, so a window inside a bucket is enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BINS = 128
LOW_BITS = 8
SHINGLE_WORDS = 5
#: Fine cuts of the id range for each bucket.
FINE = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signature(text: Column) -> Column:
    """Low-order bits of the 128 bins as array<tinyint>; an empty array if the text is null or has no words.

    Words are lower-cased runs without ASCII white space; fewer than five words are one shingle.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    value_bits = 63 - 7

    def code(h: Column) -> Column:
        """Bin in the top bits, value below."""
        bin_ = F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), value_bits)
        return bin_.bitwiseOR(F.shiftrightunsigned(h, 64 - value_bits))

    def codes(wh: Column) -> Column:
        n = F.size(wh)
        many = F.transform(
            F.sequence(F.lit(0), n - SHINGLE_WORDS),
            lambda i: code(F.xxhash64(*[F.get(wh, i + j) for j in range(SHINGLE_WORDS)])),
        )
        return F.when(n >= SHINGLE_WORDS, many).when(n > 0, F.array(code(F.xxhash64(wh)))).otherwise(F.array().cast("array<bigint>"))

    def least(sorted_codes: Column) -> Column:
        return F.filter(
            sorted_codes,
            lambda c, i: (i == 0) | (F.shiftright(c, value_bits) != F.shiftright(F.get(sorted_codes, i - 1), value_bits)),
        )

    low = F.lit((1 << LOW_BITS) - 1).cast("long")

    def dense(filled: Column) -> Column:
        own = F.transform(filled, lambda c: F.shiftleft(F.shiftright(c, value_bits), LOW_BITS).bitwiseOR(c.bitwiseAND(low)))
        empty = F.array_except(
            F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), F.transform(filled, lambda c: F.shiftright(c, value_bits))
        )
        borrowed = F.transform(
            empty,
            lambda j: F.shiftleft(j, LOW_BITS).bitwiseOR(
                F.array_min(
                    F.transform(
                        filled,
                        lambda c: F.xxhash64(j * BINS + F.shiftright(c, value_bits)).bitwiseAND(F.lit(-(1 << LOW_BITS)).cast("long")).bitwiseOR(c.bitwiseAND(low)),
                    )
                ).bitwiseAND(low)
            ),
        )
        every = F.sort_array(F.concat(own, borrowed))
        return F.transform(every, lambda v: (v.bitwiseAND(low) - 128).cast("tinyint"))

    none = F.array().cast("array<tinyint>")
    return _let(
        hashed,
        lambda wh: F.when(F.size(wh) == 0, none).otherwise(_let(F.sort_array(codes(wh)), lambda s: _let(least(s), dense))),
    )


def packed(sig: Column) -> Column:
    """A signature as lowercase hex digits, two a bin; an empty string if there are no words."""
    return F.lower(F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v.cast("long") + 128), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimate, from 0 to 1, of the Jaccard similarity of two texts' shingles.

    Two signatures without words are alike (1), one with and one without are not (0).
    """
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    est = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (agree - chance) / (1.0 - chance)))
    neither, either = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(neither, F.lit(1.0)).when(either, F.lit(0.0)).otherwise(est)


def _cuts_by_size(rows: DataFrame, key: str, size: Column, n: int) -> list[int]:
    """Keys that cut the rows into about n buckets of equal size: fine cuts by rows, of which those at equal sums of size are kept."""
    fine = rows.agg(F.percentile_approx(key, [i / (FINE * n) for i in range(1, FINE * n)], 20_000).alias("q")).first()["q"]
    fine = sorted(set(fine or []))
    place = F.size(F.filter(F.array(*map(F.lit, fine)).cast("array<bigint>"), lambda b: b <= F.col(key)))
    sizes = {r["place"]: r["size"] for r in rows.groupBy(place.alias("place")).agg(F.sum(size.cast("double")).alias("size")).collect()}  # FINE * n rows at most
    share, before, cuts = sum(sizes.values()) / n, 0.0, []
    for i, cut in enumerate(fine):
        before += sizes.get(i, 0.0)
        if before >= share * (len(cuts) + 1):
            cuts.append(cut)
            before = max(before, share * len(cuts))
    return cuts


def with_next(rows: DataFrame, key: str, carried: list[str], order: list[str], size: Column) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the next row by ``key``; the last row gets the first's.

    key: a long column without nulls. Rows of one key are ordered by ``order``. One row alone is its own next. Buckets
    of the key's range hold about equal sums of ``size``.
    """
    spark = rows.sparkSession
    n = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts_by_size(rows, key, size, n)
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    bucket = F.size(F.filter(bounds, lambda b: b <= F.col(key)))
    firsts = sorted((r["b"], r["k"]) for r in rows.groupBy(bucket.alias("b")).agg(F.min(key).alias("k")).collect())  # at most n rows
    if not firsts:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}  # a bucket's first row also ends the bucket before
    halo = F.element_at(F.create_map(*[F.lit(x).cast("bigint" if j == 0 else "int") for k, b in before.items() for j, x in enumerate((k, b))]), F.col(key))
    places = F.when(F.col(key).isin(list(before)), F.array(F.struct(bucket.alias("b"), F.lit(0).alias("h")), F.struct(halo.alias("b"), F.lit(1).alias("h")))).otherwise(
        F.array(F.struct(bucket.alias("b"), F.lit(0).alias("h")))
    )
    dealt = rows.select("*", F.explode(places).alias("__at"))
    w = Window.partitionBy("__at.b").orderBy("__at.h", key, *order)
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return led.where("__at.h = 0").drop("__at")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    The edited text replaces the last half of a text by as much of the next document's beginning. Null texts are
    empty; null ids come before all others; rows that share an id are ordered by text. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("__key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    rows = rows.withColumn("sig", signature(F.col("text")))
    led = with_next(rows, "__key", ["text", "sig"], ["text"], F.octet_length("text") + 64)
    led = led.withColumn("n_chars", F.length("text").cast("long")).withColumn("__half", F.expr("cast(n_chars div 2 as int)"))
    edited = F.expr("concat(left(text, cast(n_chars as int) - __half), left(next_text, __half))")
    led = led.select("doc_id", "n_chars", edited.alias("edited"), "sig", "next_sig")
    led = led.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sig", "next_sig", signature(F.col("edited")).alias("edited_sig"))
    return led.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op9_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

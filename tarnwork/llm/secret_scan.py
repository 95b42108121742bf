"""Secret scans: fixed patterns, and a battery of randomness tests on other long tokens.

Base kinds are found by pattern. Every other run of token characters is put through a battery: its encoding is
inferred from the characters it uses (hexadecimal, base32, letters of one case, base62, base64 or base64url, or all
token characters), its characters become values, and three tests hold them against uniform random ones, each by its
own null distribution at that length and alphabet size:

* chi-squared over all characters of the alphabet (Wilson and Hilferty's cube root, alphabet size - 1 degrees);
* runs above and below the middle, given how many values are above (Wald and Wolfowitz), after a test of that number;
* lag-1 serial correlation about the token's mean.

A token that fails one of them, at one in a thousand, is not random. One that passes all may still be a short word
that happens to look random, so its p-value is the probability that natural text would have a chi-squared as low:
characters of natural tokens agree with odds of ``AGREE`` at least, which makes the statistic noncentral chi-squared
with a noncentrality that grows with the length. Benjamini and Hochberg's rule over all tokens of the corpus, those
that fail the battery included, then holds the share of false discoveries under ``RATE``. Neither needs a corpus of
any size: short tokens need company to be reported, long ones do not.

The scan is SQL functions only. What it gathers from the corpus is a histogram of p-values of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.plans.shared import written

#: Base kinds in order, their patterns, and the least length of what is measured.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# a match of the open-ended pattern is a maximal run, so its least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of token characters from this length on are tested.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {  # by inferred encoding, in the order they are tried
    "^[0-9a-f]+$": "0123456789abcdef",
    "^[0-9A-F]+$": "0123456789ABCDEF",
    "^[a-z]+$": "abcdefghijklmnopqrstuvwxyz",
    "^[A-Z]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "^[A-Z2-7]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "^[A-Za-z0-9]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "^[A-Za-z0-9+/]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "^[A-Za-z0-9_-]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
}
#: Least odds that two characters of a natural token agree; about 0.065 in words of one case, less where cases mix.
AGREE = 0.05
#: Standard normal bound of each test's tail: one in a thousand on one side, or on both sides together.
ONE_SIDE, TWO_SIDES = 3.09, 3.29
#: p-values are kept as whole tenths of -log10, rounded down, up to this many.
SCORES = 3000
RATE = 0.01


def _spans(text: Column, pattern: str, kind: int, measured: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end>> of the pattern's leftmost matches, in code points.

    The text between matches and the matches themselves give the places. ``measured``: the group whose length must
    be ``least`` or more.
    """
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.transform(found, lambda m: F.length(m))
    group = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(measured)), lambda g: F.length(g)) if measured else lengths
    gaps = F.transform(F.slice(between, F.lit(1), F.size(between) - 1), lambda b: F.length(b))
    pairs = F.zip_with(lengths, gaps, lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    sizes = F.zip_with(pairs, group, lambda x, g: F.struct(x["m"].alias("m"), x["b"].alias("b"), g.alias("g")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["b"]
        end = begin + x["m"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["g"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(sizes, start, step, lambda a: a["out"])).otherwise(empty)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _bits(token: Column) -> Column:
    """struct of what the tests need: n (length), a (alphabet size), squares (sum of squared counts), v (values)."""
    bare = F.regexp_replace(token, "=+$", "")
    alphabet = F.coalesce(*[F.when(bare.rlike(p), F.lit(a)) for p, a in ALPHABETS.items() if p], F.lit(ALPHABETS[""]))

    def measure(x: Column) -> Column:
        n = F.length(x["t"]).cast("double")
        counts = F.transform(F.split(x["a"], ""), lambda c: n - F.length(F.replace(x["t"], c)))
        return F.struct(
            n.alias("n"),
            F.length(x["a"]).cast("double").alias("a"),
            F.aggregate(counts, F.lit(0.0), lambda s, k: s + k * k).alias("squares"),
            F.transform(F.split(x["t"], ""), lambda c: (F.instr(x["a"], c) - 1).cast("double")).alias("v"),
        )

    return _let(F.struct(alphabet.alias("a"), bare.alias("t")), measure)


def chi_squared(x: Column) -> Column:
    """Pearson's statistic of a token against a uniform alphabet."""
    return x["a"] * x["squares"] / x["n"] - x["n"]


def tests(x: Column) -> Column:
    """struct of standard normal scores of ``_bits`` under uniform random characters: chi, high, runs, serial."""
    n, v, df = x["n"], x["v"], x["a"] - 1
    chi = (F.pow(chi_squared(x) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    middle = x["a"] / 2
    pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    high = F.size(F.filter(v, lambda i: i >= middle)).cast("double")
    runs = 1.0 + F.size(F.filter(pairs, lambda p: (p["p"] >= middle) != (p["q"] >= middle)))
    mean_runs = 2 * high * (n - high) / n + 1
    var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(0.25))
    # sums first: a mean inside a lambda would be taken anew for every value
    total = F.aggregate(v, F.lit(0.0), lambda s, i: s + i)
    centre = total / n
    spread = F.aggregate(v, F.lit(0.0), lambda s, i: s + i * i) - total * centre
    products = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["p"] * p["q"])
    lagged = products - centre * (2 * total - F.element_at(v, 1) - F.element_at(v, -1)) + (n - 1) * centre * centre
    serial = F.when(spread > 1e-9, lagged / spread).otherwise(F.lit(1.0))
    return F.struct(
        chi.alias("chi"),
        ((2 * high - n) / F.sqrt(n)).alias("high"),
        ((runs - mean_runs) / F.sqrt(var_runs)).alias("runs"),
        ((serial + 1 / n) * n * F.sqrt(n - 1) / (n - 2)).alias("serial"),
    )


def natural_score(x: Column) -> Column:
    """-10 log10 of the probability that natural text of that length and alphabet has a chi-squared as low, 0 or more."""
    df = x["a"] - 1
    shift = F.greatest((x["n"] - 1) * (x["a"] * AGREE - 1), F.lit(0.0))
    whole = df + shift
    spread = 2 * (df + 2 * shift) / (9 * whole * whole)
    below = ((1 - spread) - F.pow(chi_squared(x) / whole, F.lit(1 / 3))) / F.sqrt(spread)
    # an upper bound of the normal tail, close at all values above 0
    tail = -below * below / 2 + F.log(2 / (F.sqrt(F.lit(6.283185307179586)) * (below + F.sqrt(below * below + 2.5464790894703255))))
    return F.when(below > 0, -10 * tail / 2.302585092994046).otherwise(F.lit(0.0))


def score(token: Column) -> Column:
    """Whole tenths of -log10 of the token's p-value; 0 if it fails the battery."""

    def judge(x: Column) -> Column:
        def passed(z: Column) -> Column:
            ok = (z["chi"] <= ONE_SIDE) & (F.abs(z["high"]) <= TWO_SIDES) & (F.abs(z["runs"]) <= TWO_SIDES) & (F.abs(z["serial"]) <= TWO_SIDES)
            return F.when(ok, F.least(F.floor(natural_score(x)), F.lit(SCORES)).cast("int")).otherwise(F.lit(0))

        return F.when(x["n"] > 2, _let(tests(x), passed)).otherwise(F.lit(0))  # nothing but padding has no score

    return _let(_bits(token), judge)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with __base (array of spans) and __tokens (array of struct<start, end, score>).

    Tokens that overlap a base span are left out. Null texts are empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns(
        {
            "__base": F.sort_array(F.concat(_spans(text, ASSIGN, 0, 2, ASSIGN_LEAST), _spans(text, ACCESS, 1), _spans(text, HEX, 2))),
            "__long": _spans(text, TOKEN, 3),
        }
    )

    def token(s: Column) -> Column:
        word = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), score(word).alias("score"))

    free = F.filter("__long", lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.withColumn("__tokens", F.transform(free, token)).drop("__long")


def least_score(counts: dict[int, int], rate: float = RATE) -> int:
    """The score from which tokens are reported, from the number of tokens of each score (Benjamini and Hochberg)."""
    total, above, least = sum(counts.values()), 0, SCORES + 1
    for value in sorted(counts, reverse=True):
        above += counts[value]
        if value and 10.0 ** (-value / 10) * total <= rate * above:
            least = value
    return least


def _all_spans(scanned: DataFrame, rate: float) -> Column:
    """Base spans and reported tokens of a scanned row, where ``scanned`` has the __tokens of the whole corpus."""
    counts = scanned.select(F.explode("__tokens.score").alias("score")).groupBy("score").count()
    least = least_score({r["score"]: r["count"] for r in counts.collect()}, rate)  # SCORES + 1 rows at most
    kept = F.filter("__tokens", lambda t: t["score"] >= least)
    more = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    return F.sort_array(F.concat("__base", more))


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and spans: arrays of struct<start, kind, end> by start and kind, one row for each document.

    kind counts in KINDS. ``spans`` holds the base spans and the reported tokens. Null texts have none; repeated
    rows stay repeated; other columns are ignored; no rows give no rows.
    """
    seen = written(scan(docs.select(F.col("doc_id").cast("long"), "text")).drop("text"), "tokens")
    return seen.select("doc_id", F.col("__base").alias("base"), _all_spans(seen, rate).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; n_chars follows if there is such a column.

    Overlapping spans become one mark. Rows without a secret and null texts stay as they are; columns and row count
    stay. The rows are written once beside their tokens, since what is replaced depends on the tokens of all.
    """
    seen = written(scan(docs), "scanned")
    marked = seen.withColumn("__spans", _all_spans(seen, rate))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        apart = s["start"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def ended(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring("text", (acc["at"] + 1).cast("int"), F.length("text")))

    text = F.when(F.size("__spans") > 0, F.aggregate("__spans", start, step, ended)).otherwise(F.col("text"))
    out = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def _told(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts of base kinds, a digest of the base spans, and all spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_told("base").cast("binary"), 256).alias("base_sha256"),
        _told("spans").alias("spans"),
    )

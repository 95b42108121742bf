"""Sanitising of texts: ordered steps that count and replace what must not be kept.

Later steps see what earlier ones put in, so their order matters. Secrets are found by an own pack of patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import BOUNDARY, nfkc

#: What each step looks for, and what it puts in its place.
PATTERNS = {
    "control_character": (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f​-‏‪-‮⁠﻿]", ""),
    "internal_host": (rf"(?i){BOUNDARY}(?:https?://)?(?:[A-Za-z0-9-]+\.)+(?:internal|corp|lan|local)(?::\d{{1,5}})?{BOUNDARY}", "[REDACTED_INTERNAL_HOST]"),
    "private_ip": (rf"(?=1){BOUNDARY}(?:10(?:\.\d{{1,3}}){{3}}|192\.168(?:\.\d{{1,3}}){{2}}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{{1,3}}){{2}}){BOUNDARY}", "[REDACTED_INTERNAL_HOST]"),
    "repository_url": (rf"(?i){BOUNDARY}https?://(?:github\.com|gitlab\.com|bitbucket\.org)/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:\.git)?{BOUNDARY}", "[REDACTED_REPOSITORY]"),
    "secret": (rf"(?=[Agnsx]){BOUNDARY}(?:AKIA[A-Z0-9]{{16}}|gh[pousr]_[A-Za-z0-9]{{36,}}|xox[abprs]-[A-Za-z0-9-]{{10,}}|sk_live_[A-Za-z0-9]{{16,}}|npm_[A-Za-z0-9]{{36}}){BOUNDARY}|-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_SECRET]"),
    "email": (rf"(?i){BOUNDARY}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{BOUNDARY}", "[REDACTED_EMAIL]"),
    "unix_home": (r"/(?:Users|home)/[^/\s]+", r"\$HOME"),
    "windows_home": (r"[A-Za-z]:\\Users\\[^\\\s]+", r"\$HOME"),
    "credential_url": (rf"(?i){BOUNDARY}((?:https?|ssh|git|mongodb(?:\+srv)?)://)[^\s/@:]+:[^\s/@]+@", "$1"),
    "sensitive_query": (r"(?i)([?&](?:token|key|api_key|apikey|secret|password|signature|credential)=)[^&#\s]+", r"$1[REDACTED]"),
}
#: A look at a pattern's first letter comes before the dearer look at the word's border.
#: Text that every match of a step holds: rows without it skip the pattern.
NEEDED = {"repository_url": "://", "email": "@", "unix_home": "/", "windows_home": ":\\", "credential_url": "@", "sensitive_query": "="}
#: The same, where it takes a cheap pattern to tell.
HINTS = {"internal_host": r"(?i)\.(?:internal|corp|lan|local)"}
STEPS = tuple(PATTERNS)
SHORT_STEPS = ("control_character", "secret", "email", "unix_home", "windows_home", "credential_url", "sensitive_query")
INJECTION = (
    rf"(?i)(?=i){BOUNDARY}ignore (?:all |any )?(?:previous|prior|system|developer) instructions{BOUNDARY}",
    rf"(?i)(?=[reps]){BOUNDARY}(?:reveal|print|exfiltrate|send) (?:the )?(?:system prompt|credentials|secrets?|tokens?){BOUNDARY}",
    rf"(?i)(?=[eci]){BOUNDARY}(?:execute|call|invoke) (?:this |the )?(?:tool|command){BOUNDARY}",
    rf"(?i)(?=y){BOUNDARY}you are now (?:the |an? )?",
    rf"(?i)(?=d){BOUNDARY}do not treat (?:this|the following) as data{BOUNDARY}",
)
#: White space and line ends of JavaScript, at either end of a text.
_EDGES = "[\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
EDGES = f"^{_EDGES}+|(?<!{_EDGES}){_EDGES}+$"
CODE_LINE = r"^\s*(?:import |export |class |function |const |let |var |interface |type |[{}]|</?[A-Za-z])"


def step(df: DataFrame, name: str) -> DataFrame:
    """Replace what the step looks for in ``text``; ``found`` (int) counts it. A null text has none."""
    pattern, put = PATTERNS[name]
    may = F.col("text").rlike(HINTS[name]) if name in HINTS else F.col("text").contains(NEEDED.get(name, ""))
    out = df.withColumn("__new", F.when(may, F.regexp_replace("text", pattern, put)).otherwise(F.col("text")))
    # most texts have no match: they are searched once, and counted in only if they changed or might hold what is put in
    some = (F.col("__new") != F.col("text")) | F.col("text").contains("[REDACTED]")
    found = F.when(some, F.regexp_count("text", F.lit(pattern))).otherwise(0)
    return out.withColumn("found", found).withColumn("text", F.col("__new")).drop("__new")


def injection_hits(c: Column) -> Column:
    return sum(c.rlike(p).cast("int") for p in INJECTION)


def residual_secret(c: Column) -> Column:
    return c.rlike(r"-----BEGIN [A-Z ]*PRIVATE KEY-----") | c.rlike(PATTERNS["secret"][0])


def excessive_source(c: Column) -> Column:
    lines = F.split(c, "\n")
    return (F.size(lines) > 40) | ((F.size(lines) >= 12) & (F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE))) >= 10))


def mostly_redacted(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0), before - after) > 0.6 * before


def sanitize(df: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """``df`` with a sanitised, trimmed ``text``, counts ``n_<step>``, and ``status``: rejected, quarantined, sanitized or clean.

    A null text is clean and stays null.
    """
    out = df.withColumn("__size", F.length("text")).withColumn("text", nfkc(F.col("text")))
    for name in steps:
        out = step(out, name).withColumnRenamed("found", f"n_{name}")
    total = sum(F.coalesce(F.col(f"n_{s}"), F.lit(0)) for s in steps)
    bad = residual_secret(F.col("text")) | excessive_source(F.col("text")) | mostly_redacted(F.col("__size"), F.length("text"))
    status = (
        F.when(bad, "rejected")
        .when(injection_hits(F.col("text")) > 0, "quarantined")
        .when(total > 0, "sanitized")
        .otherwise("clean")
    )
    return out.withColumn("status", status).withColumn("text", F.regexp_replace("text", EDGES, "")).drop("__size")


def finding_counts(df: DataFrame, steps: list[str]) -> DataFrame:
    """category, findings, documents: how often each step's pattern occurs, and in how many texts."""
    wide = df.agg(*[F.struct(F.lit(s).alias("category"), F.sum(F.regexp_count("text", F.lit(PATTERNS[s][0]))).alias("findings"), F.count_if(F.col("text").rlike(PATTERNS[s][0])).alias("documents")).alias(s) for s in steps])
    return wide.select(F.inline(F.array(*steps)))


def containing(texts: DataFrame, passages: DataFrame, most: int = 100_000) -> DataFrame:
    """doc_id and item_id of each text that holds a passage as a substring, by one pass of an automaton over each text.

    ``passages`` is a benchmark: more than ``most`` of them raise an error rather than being broadcast.
    """
    rows = passages.where("text is not null and text <> ''").select("item_id", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} passages")
    shared = texts.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        found = ahocorasick.Automaton()
        held: dict[str, list[int]] = {}
        for item, passage in shared.value:
            held.setdefault(passage, []).append(item)
        for passage, items in held.items():
            found.add_word(passage, items)
        if held:
            found.make_automaton()
        for b in batches:
            out = [(d, i) for d, t in zip(b["doc_id"], b["text"]) if t and held for i in sorted({i for _, items in found.iter(t) for i in items})]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    return texts.select("doc_id", "text").mapInPandas(search, "doc_id long, item_id long")

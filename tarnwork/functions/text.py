"""Text normalisers, identifiers and shingles, as Column expressions.

Word boundaries are ASCII: between a letter, digit or underscore and anything else. They are spelled out, since Java's
own boundary looks at all of Unicode.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_W = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

#: What a query's error text hides, in order, and what codes and classes look like in queries, in stored
#: errors and in profiles. The three kinds of codes differ on purpose.
ERROR_TEXT_STEPS = (
    (rf"(?i){BOUNDARY}(?:[a-z]:)?[\\/](?:users|home|tmp|private|var|data)[\\/][^\s:]+", "<path>"),
    (rf":\d+(?::\d+)?{BOUNDARY}", ":<line>"),
    (rf"(?i){BOUNDARY}[0-9a-f]{{8}}-[0-9a-f-]{{27,}}{BOUNDARY}", "<uuid>"),
    (rf"(?i){BOUNDARY}\d{{4}}-\d{{2}}-\d{{2}}[T ][0-9:.+-]+Z?{BOUNDARY}", "<timestamp>"),
)
QUERY_CODES = (rf"(?i){BOUNDARY}(?:ERR_[A-Z0-9_]+|TS\d{{3,5}}|[A-Z]{{2,}}-\d{{2,}}){BOUNDARY}", rf"{BOUNDARY}E[A-Z]{{2,10}}{BOUNDARY}")
STORED_CODES = rf"{BOUNDARY}(?:ERR_[A-Z0-9_]+|E[A-Z]{{2,10}}|TS\d{{3,5}}|[A-Z]{{2,}}-\d{{2,}}){BOUNDARY}"
STORED_CLASSES = rf"{BOUNDARY}(?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*(?:Error|Exception){BOUNDARY}"
PROFILE_CODES = rf"{BOUNDARY}(?:ERR_[A-Z0-9_]+|TS\d{{3,5}}|EAS_[A-Z0-9_]+|[A-Z][A-Z0-9_]{{2,}}_ERROR|E[A-Z]{{2,}}\d*){BOUNDARY}"
PROFILE_CLASSES = rf"{BOUNDARY}(?:(?:[A-Za-z_$][\w$]*)\.)*[A-Z][A-Za-z0-9_$]*(?:Error|Exception){BOUNDARY}"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """NFKC; only texts beyond ASCII go to Python."""
    odd = c.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


def collapse(c: Column) -> Column:
    """White space of any kind becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """NFKC, line ends as \\n, trimmed."""
    return F.regexp_replace(F.regexp_replace(nfkc(c), "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")


def normalize_inline(c: Column) -> Column:
    """NFKC and collapsed white space."""
    return collapse(nfkc(c))


def slug(c: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Registries whose package names ignore case.
CASELESS_REGISTRIES = ("npm", "jsr", "pypi", "nuget", "crates-io")


def package_name(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem.isin(*CASELESS_REGISTRIES), F.lower(F.trim(name))).otherwise(F.trim(name))


def iso_timestamp(c: Column) -> Column:
    """ISO 8601 with milliseconds and Z; the session's time zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda w: w != ""))


def truncated_title(c: Column) -> Column:
    return F.when(F.length(c) > 256, F.concat(F.substring(c, 1, 253), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def error_text(c: Column) -> Column:
    """A query's error text: transient paths, lines, ids and times become placeholders; lower case."""
    out = collapse(c)
    for pattern, put in ERROR_TEXT_STEPS:
        out = F.regexp_replace(out, pattern, put)
    return F.lower(out)


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


#: What every text with a code of QUERY_CODES holds.
_CODE_HINT = r"(?i:err_|ts\d{3}|[a-z]{2}-\d{2})|E[A-Z]{2}"


def query_error_codes(c: Column) -> Column:
    """Codes named in a query, lower case, in order of appearance by pattern."""
    loose, strict = (_all(c, p) for p in QUERY_CODES)
    found = F.array_distinct(F.transform(F.concat(loose, strict), lambda x: F.lower(x)))
    return F.when(c.isNull() | c.rlike(_CODE_HINT), found).otherwise(F.array().cast("array<string>"))


def projection_error_codes(c: Column) -> Column:
    """Codes in stored errors: matched in their own case, distinct and sorted, then lower-cased."""
    found = _all(c, STORED_CODES)
    return F.transform(F.array_sort(F.array_distinct(found)), lambda x: F.lower(x))


def projection_exception_classes(c: Column) -> Column:
    found = _all(c, STORED_CLASSES)
    return F.transform(F.array_sort(F.array_distinct(found)), lambda x: F.lower(x))


def profile_error_codes(c: Column) -> Column:
    found = _all(c, PROFILE_CODES)
    return F.array_sort(F.transform(F.array_distinct(found), lambda x: F.upper(x)))


def profile_exception_classes(c: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(c, PROFILE_CLASSES)))


#: What is transient in technical text, what replaces it, and the reason recorded, in order.
TECHNICAL_STEPS = (
    (rf"(?i){BOUNDARY}[A-Za-z]:\\(?:Users|Temp|tmp|AppData\\Local\\Temp)\\[^\s\"'`]+", "<path>", "normalized_windows_transient_path"),
    (r"(?i)(?:/Users/[^\s/]+|/home/[^\s/]+|/tmp|/private/var/folders|/var/folders)/[^\s\"'`]+", "<path>", "normalized_posix_transient_path"),
    (r"(?i)(?:/(?:\.expo|\.gradle|\.cache|DerivedData|intermediates|tmp))/[0-9a-f-]{12,}(?=/|\s|$)", "/<build-id>", "normalized_transient_build_segment"),
    (rf"(?i){BOUNDARY}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}{BOUNDARY}", "<uuid>", "normalized_uuid"),
    (rf"(?i){BOUNDARY}\d{{4}}-\d{{2}}-\d{{2}}[T ][0-2]\d:[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}}){BOUNDARY}", "<timestamp>", "normalized_timestamp"),
    (rf"(?i)(?<=\.[cm]?[jt]sx?|\.[a-z]{{1,5}}):\d+(?::\d+)?{BOUNDARY}", ":<line>", "normalized_stack_location"),
    (rf"(?i){BOUNDARY}(build|request|trace|session|correlation)[-_ ]?id\s*[:=]\s*[0-9a-f-]{{16,}}{BOUNDARY}", "$1-id:<id>", "normalized_contextual_identifier"),
)


#: What a text must hold for a step above to change it, in the same order; searched first, since it is far quicker.
_TECHNICAL_HINTS = (r":\\", "/", "/", "[0-9a-f]-[0-9a-f]{4}-", "[0-2][0-9]:[0-5]", ":[0-9]", r"id\s*[:=]")


def _replaced_where(c: Column, hint: str, pattern: str, put: str) -> Column:
    """``c`` with ``pattern`` replaced if it holds ``hint``; named once, so that steps in a row do not repeat their input."""
    return F.element_at(F.transform(F.array(c), lambda t: F.when(t.rlike(hint), F.regexp_replace(t, pattern, put)).otherwise(t)), 1)


def technical_text(c: Column) -> tuple[Column, Column]:
    """(text, reasons): lower-cased text without transient parts, and the sorted reasons for what was replaced."""
    text, reasons = F.lower(collapse(c)), []
    for (pattern, put, reason), hint in zip(TECHNICAL_STEPS, _TECHNICAL_HINTS, strict=True):
        reasons.append(F.when(text.rlike(hint) & text.rlike(pattern), F.lit(reason)))
        text = _replaced_where(text, hint, pattern, put)
    return collapse(text), F.array_sort(F.array_compact(F.array(*reasons)))


#: What stands between tokens. Java looks up single characters in a table and tests ranges one by one, which takes six times as long.
BETWEEN_TOKENS = "[^abcdefghijklmnopqrstuvwxyz0123456789_@./<>:-]+"


def shingle_texts(c: Column, width: int = 3) -> Column:
    """Distinct runs of ``width`` tokens; shorter texts are one run; tokens of one character do not count."""
    tokens = F.filter(F.split(c, BETWEEN_TOKENS), lambda t: F.length(t) > 1)

    def runs(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (width - 1)), lambda i: F.array_join(F.slice(t, i, width), " "))
        return F.when(F.size(t) >= width, F.array_distinct(many)).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(tokens), runs), 1)


def shingles(c: Column, width: int = 3) -> Column:
    """Sorted SHA-256 of the distinct token runs."""
    return F.sort_array(F.transform(shingle_texts(c, width), lambda s: F.sha2(s.cast("binary"), 256)))


def json_string(c: Column) -> Column:
    """A string as JSON writes it, with quotes."""
    inner = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(c.isNull(), F.lit("null")).otherwise(inner)


def versioned_key(*parts: Column, version: int = 1) -> Column:
    """SHA-256 of the JSON array of a version and text parts."""
    body = F.concat(F.lit(f"[{version},"), F.concat_ws(",", *[json_string(p) for p in parts]), F.lit("]"))
    return F.sha2(body.cast("binary"), 256)


def version_text(c: Column) -> Column:
    """Trimmed, lower case, without a v before a digit."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^v(?=\d)", "")


def major(c: Column) -> Column:
    """The first whole number of a version text; null if there is none."""
    found = F.regexp_extract(c, r"(?:^|[^0-9])(\d+)(?:\.\d+)?", 1)
    return F.when(found != "", found)


def classify(material: Column, rules: list[tuple[str, str]], fallback: str) -> Column:
    """The type of the first rule (type, pattern) that matches, whatever the case; else ``fallback``."""
    return F.coalesce(*[F.when(material.rlike(f"(?i){p}"), F.lit(t)) for t, p in rules], F.lit(fallback))


def detect_versions(material: Column, rules: list[tuple[str, int]]) -> Column:
    """Sorted distinct versions that the rules (pattern, group) capture."""
    found = F.concat(*[F.regexp_extract_all(material, F.lit(f"(?i){p}"), F.lit(g)) for p, g in rules])
    return F.array_sort(F.array_distinct(F.transform(found, version_text)))

"""Predicates, pages and projections over records with visibility and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def readable(scope: str, owner: str | int | None = None, workspace: str | None = None) -> Column:
    """What one access may read: public, private rows of an owner, or team rows of a workspace.

    Works on columns visibility, owner_id and workspace_id, as a plain predicate that reaches the scan.
    """
    if scope == "public":
        return F.col("visibility") == "public"
    if scope == "private":
        return (F.col("visibility") == "private") & (F.col("owner_id") == owner)
    if scope == "team":
        return (F.col("visibility") == "team") & (F.col("workspace_id") == workspace)
    raise ValueError(scope)


def readable_by_any(accesses: list[dict]) -> Column:
    out = F.lit(False)
    for a in accesses:
        out = out | readable(**a)
    return out


#: Statuses that may be read, by kind of access.
OPEN_STATUSES = {
    "public": ("active", "deprecated"),
    "review": ("draft", "review", "active", "deprecated"),
    "private": ("draft", "review", "active", "deprecated"),
}


def accessible_status(kind: str) -> Column:
    return F.col("status").isin(*OPEN_STATUSES[kind])


def page(df: DataFrame, at: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """The rows after a boundary (at, id), newest first, one more than ``size`` so that the caller sees whether more follow."""
    if after is not None:
        df = df.where((F.col(at) < after[0]) | ((F.col(at) == after[0]) & (F.col(key) < after[1])))
    return df.orderBy(F.desc(at), F.desc(key)).limit(size + 1)


def admin_search(df: DataFrame, text: str, paths: list[str]) -> DataFrame:
    """Rows in which any of the columns holds the text, whatever the case; no character of it is special."""
    hit = F.lit(False)
    for p in paths:
        hit = hit | F.coalesce(F.lower(F.col(p)).contains(text.lower()), F.lit(False))
    return df.where(hit)


def fifo(df: DataFrame, at: str, key: str, limit: int, where: Column) -> DataFrame:
    """The oldest rows that wait for work."""
    return df.where(where).orderBy(F.asc(at), F.asc(key)).limit(limit)


def masked_title(title: Column, visibility: Column, kind: str, key: Column) -> Column:
    return F.when(visibility == "private", F.concat(F.lit(f"Private {kind} "), key.cast("string"))).otherwise(title)


def safe_provenance(df: DataFrame) -> DataFrame:
    """Bounded provenance: title 500, locator 500 and excerpt 1,000 characters, and an authority where it is missing."""
    return df.withColumns(
        {
            "title": F.substring("title", 1, 500),
            "locator": F.substring("locator", 1, 500),
            "excerpt": F.substring("excerpt", 1, 1000),
            "authority": F.coalesce("authority", F.lit("unknown")),
        }
    )


def compact(lists: dict[str, int]) -> dict[str, Column]:
    """Lists cut to their limits, and ``truncated`` if any was longer."""
    out = {c: F.slice(c, 1, n) for c, n in lists.items()}
    longer = F.lit(False)
    for c, n in lists.items():
        longer = longer | (F.size(c) > n)
    return out | {"truncated": longer}


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row (keys, rule) for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))

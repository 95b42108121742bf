"""Checks of JSON against a schema, compiled to one Column: a list of (path, problem) for each value.

A schema is a tree of ``Text``, ``Listed`` and ``Record``. Values are VARIANT, so a text is parsed once, whatever its
shape. Paths name fields and positions from 0, joined by dots; the whole value has the empty path. Problems: ``type``,
``required``, ``choice``, ``format``, ``short``, ``long``, ``unknown_key`` and those of a record's own rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUES = "array<struct<path:string,problem:string>>"
MOST_ISSUES = 32


def _none() -> Column:
    return F.array().cast(ISSUES)


def _issue(path: Column, problem: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem"))).cast(ISSUES)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _below(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _named(v: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``v``, which is written once in the plan."""
    return F.element_at(F.transform(F.array(v), use), 1)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@dataclass(frozen=True)
class Text:
    """A string; lengths are code points after trimming. A blank one counts as absent where ``blank`` says so."""

    most: int | None = None
    least: int = 1
    choices: tuple[str, ...] = ()
    pattern: str | None = None
    trim: bool = True
    blank: bool = False

    def issues(self, v: Column, path: Column) -> Column:
        def of(s: Column) -> Column:
            text = trimmed(s) if self.trim else s
            out = F.when(s.isNull(), _issue(path, "type"))
            if self.blank:
                out = out.when(trimmed(s) == "", _none())
            if self.choices:
                return out.when(~s.isin(*self.choices), _issue(path, "choice")).otherwise(_none())
            if self.pattern:
                out = out.when(~s.rlike(self.pattern), _issue(path, "format"))
            out = out.when(F.length(text) < self.least, _issue(path, "short"))
            return (out if self.most is None else out.when(F.length(text) > self.most, _issue(path, "long"))).otherwise(_none())

        return _named(F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")), of)


@dataclass(frozen=True)
class Listed:
    """An array of ``item``; its items' issues come before that of its size."""

    item: Text | Record
    most: int
    least: int = 0

    def issues(self, v: Column, path: Column) -> Column:
        def of(items: Column) -> Column:
            each = F.flatten(F.transform(items, lambda x, i: self.item.issues(x, _below(path, i.cast("string")))))
            size = F.when(F.size(items) < self.least, _issue(path, "short")).when(F.size(items) > self.most, _issue(path, "long")).otherwise(_none())
            return F.when(items.isNull(), _issue(path, "type")).otherwise(F.concat(each, size))

        return _named(F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), of)


@dataclass(frozen=True)
class Record:
    """An object with these fields only. ``rules`` are (holds of the value, problem), asked where nothing else is wrong."""

    fields: dict[str, Text | Listed | Record]
    optional: frozenset[str] = frozenset()
    rules: tuple[tuple[Callable[[Column], Column], str], ...] = field(default=())

    def issues(self, v: Column, path: Column) -> Column:
        def one(name: str, node: Text | Listed | Record) -> Column:
            absent = _none() if name in self.optional else _issue(_below(path, F.lit(name)), "required")
            return _named(F.try_variant_get(v, f"$.{name}", "variant"), lambda x: F.when(x.isNull(), absent).otherwise(node.issues(x, _below(path, F.lit(name)))))

        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        more = F.when(F.size(F.array_except(keys, F.array(*map(F.lit, self.fields)))) > 0, _issue(path, "unknown_key")).otherwise(_none())
        found = F.when(~_kind(v).startswith("OBJECT"), _issue(path, "type")).otherwise(F.concat(*[one(n, node) for n, node in self.fields.items()], more))
        if not self.rules:
            return found
        broken = F.concat(*[F.when(F.coalesce(holds(v), F.lit(False)), _none()).otherwise(_issue(path, problem)) for holds, problem in self.rules])
        return _named(found, lambda f: F.when(F.size(f) > 0, f).otherwise(broken))


def issues(v: Column, schema: Text | Listed | Record) -> Column:
    """The first MOST_ISSUES issues of a variant; a null one (no JSON) has the single issue ``invalid_json``."""
    found = F.slice(schema.issues(v, F.lit("")), 1, MOST_ISSUES)
    return F.when(v.isNull(), _issue(F.lit(""), "invalid_json")).otherwise(found)

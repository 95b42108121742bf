"""Readers of source documents: indexes, sitemaps, feeds, Markdown, HTML and discussion threads.

Texts come as columns (fetching is not a Spark matter), so each reader is a transformation from rows of raw text to
rows of what is in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import text, urls

MAX_BLOCKS, MAX_CHARS = 20_000, 100_000


def load_manifest(spark, path: str) -> DataFrame:
    """Sources of a manifest (a JSON object with ``sources``), one row each; duplicate keys and unknown kinds raise.

    Rows have key, kind, enabled, url and rules (array<struct<type, pattern>>).
    """
    schema = "sources array<struct<key:string,kind:string,enabled:boolean,url:string,rules:array<struct<type:string,pattern:string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("sources"))
    kinds = ("documentation", "release_feed", "github")
    n = F.count("*").over(Window.partitionBy("key"))
    ok = F.col("kind").isin(*kinds) & F.col("url").startswith("https://") & (F.col("__n") == 1)
    checked = rows.withColumn("__n", n).withColumn("__ok", F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.concat(F.lit("bad source "), F.coalesce("key", F.lit("?"))))))
    return checked.where("__ok is null").drop("__n", "__ok").withColumn("url", urls.normalize_url(F.col("url")))


def selected_sources(sources: DataFrame, key: str | None = None) -> DataFrame:
    """Enabled sources other than GitHub's: all, or the one of a key."""
    out = sources.where(F.col("enabled") & (F.col("kind") != "github"))
    return out if key is None else out.where(F.col("key") == key)


def parse_index(docs: DataFrame, id_column: str, body: str, rules: list[tuple[str, str]], version_rules: list[tuple[str, int]]) -> DataFrame:
    """Links of an index in Markdown lists: id, url, title, section, kind, versions; the first of equal URLs counts."""
    lines = docs.select(id_column, F.posexplode(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n")).alias("pos", "line"))
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)
    w = Window.partitionBy(id_column).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(F.when(heading != "", text.collapse(heading)), ignorenulls=True).over(w))
    link = r"^-\s+\[([^\n]+?)\]\(([^)]+)\)(?::\s*(.*))?$"
    trimmed = F.trim("line")
    found = lines.where(trimmed.rlike(link)).select(
        id_column,
        "pos",
        urls.canonical_document_url(F.regexp_extract(trimmed, link, 2)).alias("url"),
        text.collapse(F.regexp_extract(trimmed, link, 1)).alias("title"),
        "section",
        F.regexp_extract(trimmed, link, 3).alias("about"),
    )
    first = F.row_number().over(Window.partitionBy(id_column, "url").orderBy("pos"))
    found = found.withColumn("__n", first).where("__n = 1")
    material = F.concat_ws(" ", "url", "title", F.coalesce("section", F.lit("")), "about")
    return found.select(id_column, "url", "title", "section", text.classify(material, rules, "guide").alias("kind"), text.detect_versions(material, version_rules).alias("versions"))


def parse_sitemap(docs: DataFrame, id_column: str, body: str) -> DataFrame:
    """id, url, last_modified of the entries that say when they changed."""
    schema = "url array<struct<loc:string,lastmod:string>>"
    rows = docs.select(id_column, F.from_xml(F.col(body), schema).alias("x")).select(id_column, F.inline("x.url"))
    return rows.where("loc is not null and trim(lastmod) <> ''").select(id_column, urls.normalize_url(F.col("loc")).alias("url"), F.trim("lastmod").alias("last_modified"))


def parse_feed(docs: DataFrame, id_column: str, body: str) -> DataFrame:
    """Entries of RSS or Atom feeds: id, identity, url, title, published, content."""
    item = "struct<title:string,link:string,guid:string,pubDate:string,description:string>"
    entry = "struct<title:string,link:struct<_href:string>,id:string,published:string,updated:string,summary:string>"
    rows = docs.select(id_column, F.from_xml(F.col(body), f"channel struct<item:array<{item}>>, entry array<{entry}>").alias("x"))
    rss = rows.select(id_column, F.explode("x.channel.item").alias("e")).select(
        id_column, "e.title", F.col("e.link").alias("url"), F.col("e.guid").alias("given"), F.col("e.pubDate").alias("published"), F.col("e.description").alias("content")
    )
    atom = rows.select(id_column, F.explode("x.entry").alias("e")).select(
        id_column, "e.title", F.col("e.link._href").alias("url"), F.col("e.id").alias("given"), F.coalesce("e.published", "e.updated").alias("published"), F.col("e.summary").alias("content")
    )
    url = urls.normalize_url(F.col("url"))
    identity = F.concat(F.lit("feed:"), F.sha2(F.coalesce("given", url).cast("binary"), 256))
    return rss.unionByName(atom).select(id_column, identity.alias("identity"), url.alias("url"), "title", "published", F.coalesce("content", "title").alias("content"))


def markdown_blocks(body: str) -> list[tuple[str, str, int | None, str | None]]:
    """(type, text, level, language) of the blocks of a Markdown text, at most MAX_BLOCKS."""
    squeeze = lambda s: " ".join(s.split())[:MAX_CHARS]
    out: list[tuple[str, str, int | None, str | None]] = []
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    starts = re.compile(r"#{1,6}\s|```|~~~|>|[-*+]\s|\d+[.)]\s")
    i = 0
    while i < len(lines) and len(out) < MAX_BLOCKS:
        line = lines[i]
        fence = re.match(r"^(```+|~~~+)\s*(\S*)", line)
        if not line.strip():
            i += 1
        elif fence:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith(fence[1])), len(lines))
            out.append(("code", "\n".join(lines[i + 1 : end])[:MAX_CHARS], None, fence[2][:64] or None))
            i = end + 1
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            out.append(("heading", squeeze(m[2]), len(m[1]), None))
            i += 1
        else:
            kind = "blockquote" if line.startswith(">") else "list" if re.match(r"^\s*([-*+]|\d+[.)])\s", line) else "table" if "|" in line and i + 1 < len(lines) and re.match(r"^[\s|:-]+$", lines[i + 1]) and "-" in lines[i + 1] else "html" if re.match(r"^<[A-Za-z!/]", line) else "paragraph"
            j = i + 1
            while j < len(lines) and lines[j].strip() and (kind != "paragraph" or not starts.match(lines[j])):
                j += 1
            part = lines[i:j]
            if kind == "list":
                whole = "\n".join(squeeze(re.sub(r"^\s*([-*+]|\d+[.)])\s+", "", x)) for x in part)[:MAX_CHARS]
            elif kind == "blockquote":
                whole = squeeze(" ".join(re.sub(r"^>\s?", "", x) for x in part))
            elif kind == "html":
                kind, whole = "paragraph", squeeze(unescape(re.sub(r"<[^>]*>", " ", " ".join(part))))
            else:
                whole = squeeze(" ".join(part))
                kind = "admonition" if kind == "paragraph" and whole.startswith(":::") else kind
            if whole:
                out.append((kind, whole, None, None))
            i = j
    return out


def parse_markdown(docs: DataFrame, id_column: str, body: str) -> DataFrame:
    """Blocks of Markdown texts in order: id, pos, type, text, level, language. A null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, *block) for i, t in zip(b["id"], b["body"]) if t for n, block in enumerate(markdown_blocks(t))]
            yield pd.DataFrame(rows, columns=["id", "pos", "type", "text", "level", "language"]).astype({"level": "Int32"})

    got = docs.select(F.col(id_column).cast("long").alias("id"), F.col(body).alias("body")).mapInPandas(run, "id long, pos int, type string, text string, level int, language string")
    return got.withColumnRenamed("id", id_column)


def html_paragraphs(c: Column) -> Column:
    """Paragraphs of an HTML text: scripts, styles and images go, block ends become breaks, tags go."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<img\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|table|tr|article|section|header|footer|nav|body|html|head|title|blockquote|pre)\b[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, put in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(put))
    return F.filter(F.transform(F.split(out, r"\n{2,}"), text.collapse), lambda t: t != "")


def select_candidates(found: DataFrame, rules: list[tuple[str, str]] | None, version: str | None, limit: int) -> DataFrame:
    """Candidates of a curated scope: the first rule that matches gives the kind, the rest go; then version and limit."""
    if rules is not None:
        material = F.concat_ws(" ", "url", "title", F.coalesce("section", F.lit("")))
        found = found.withColumn("kind", text.classify(material, rules, "")).where("kind <> ''")
    if version is not None:
        found = found.where(F.array_contains("versions", version))
    return found.orderBy("url").limit(limit)


def thread_items(turns: DataFrame) -> DataFrame:
    """Roots and comments of threads in one shape: identity, root identity, kind, author, length."""
    root = F.concat_ws(":", F.lit("thread"), "conv_id")
    return turns.select(
        F.when(F.col("turn") == 0, root).otherwise(F.concat_ws("#", root, "turn")).alias("identity"),
        root.alias("root_identity"),
        F.when(F.col("turn") == 0, "discussion").otherwise("discussion_comment").alias("kind"),
        F.col("role").alias("author"),
        F.length("text").alias("chars"),
    )

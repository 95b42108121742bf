"""Source readers over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions.json_schema import Listed, Record, Text
from tarnwork.operators import responses
from tarnwork.plans.catalog import query, table
from tarnwork.sources import documents as src

_U = """(SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(u, '^[^:/]+://([^/?]*)', 1)) || CASE WHEN regexp_replace(regexp_extract(u, '^[^:/]+://[^/?]*([^?]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(u, '^[^:/]+://[^/?]*([^?]*)', 1), '/+$', '') END || regexp_extract(u, '^[^?]*(\\?.*)$', 1) AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages))"""
_KIND = "CASE WHEN regexp_matches(m, '/fr/', 'i') THEN 'migration_guide' WHEN regexp_matches(m, 'page=', 'i') THEN 'release_note' ELSE 'guide' END"
RULES, VERSIONS = [("migration_guide", "/fr/"), ("release_note", "page=")], [(r"v(\d+\.\d+)", 1)]


def index_rows(spark, sf_dir):
    """An index text for each page: a heading and two links, one of them twice."""
    p = table(spark, sf_dir, "pages")
    body = F.concat(F.lit("# Docs\n\n## Part "), F.col("page_id") % 5, F.lit("\n- [Page  "), "page_id", F.lit("]("), "url", F.lit("): for v1."), F.col("page_id") % 9, F.lit(" and V2.0\n- not a link\n- [Again]("), "url", F.lit(")"))
    return src.parse_index(p.select("page_id", body.alias("body")), "page_id", "body", RULES, VERSIONS)


_INDEX = f"(SELECT page_id, url, 'Page ' || page_id AS title, 'Part ' || (page_id % 5) AS section, {_KIND.replace('m,', 'url,')} AS kind, '1.' || (page_id % 9) || ',2.0' AS versions FROM {_U})"


@query("S3_index_links", f"SELECT page_id, url, title, section, kind, versions FROM {_INDEX}")
def s3(spark, sf_dir):
    return index_rows(spark, sf_dir).withColumn("versions", F.array_join("versions", ","))


@query("S8_candidate_selection", f"SELECT page_id, url, kind FROM {_INDEX} WHERE kind = 'migration_guide' AND contains(versions, '1.3') ORDER BY url LIMIT 50")
def s8(spark, sf_dir):
    return src.select_candidates(index_rows(spark, sf_dir), RULES[:1], "1.3", 50).select("page_id", "url", "kind")


@query("S4_sitemap", f"SELECT page_id, url, '2024-01-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') AS last_modified FROM {_U} WHERE page_id % 4 <> 0")
def s4(spark, sf_dir):
    day = F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0")
    when = F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("2024-01-"), day))
    body = F.concat(F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), when, F.lit("</lastmod></url><url><loc>https://x.example/</loc></url></urlset>"))
    return src.parse_sitemap(table(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id", "body")


@query("S5_feed_entries", f"SELECT page_id, 'feed:' || sha256(CASE WHEN page_id % 2 = 0 THEN 'g' || page_id ELSE url END) AS identity, url, 'T' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN 'about ' || page_id ELSE 'T' || page_id END AS content FROM {_U}")
def s5(spark, sf_dir):
    i = F.col("page_id")
    link = F.replace("url", F.lit("&"), F.lit("&amp;"))
    guid = lambda tag: F.when(i % 2 == 0, F.concat(F.lit(f"<{tag}>g"), i, F.lit(f"</{tag}>"))).otherwise("")
    about = lambda tag: F.when(i % 3 == 0, F.concat(F.lit(f"<{tag}>about "), i, F.lit(f"</{tag}>"))).otherwise("")
    rss = F.concat(F.lit("<rss><channel><item><title>T"), i, F.lit("</title><link>"), link, F.lit("</link>"), guid("guid"), about("description"), F.lit("</item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>T"), i, F.lit('</title><link href="'), link, F.lit('"/>'), guid("id"), about("summary"), F.lit("</entry></feed>"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(i % 4 < 2, rss).otherwise(atom).alias("body"))
    return src.parse_feed(rows, "page_id", "body").drop("published")


@query("S6_markdown_blocks", "SELECT doc_id, 'heading' AS type, 'Title ' || doc_id AS text, 2 AS level FROM documents UNION ALL SELECT doc_id, 'list', lang || chr(10) || source, NULL FROM documents UNION ALL SELECT doc_id, 'code', 'x = ' || doc_id, NULL FROM documents UNION ALL SELECT doc_id, 'blockquote', 'said ' || lang, NULL FROM documents")
def s6(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("## Title "), "doc_id", F.lit("\n\n- "), "lang", F.lit("\n- "), "source", F.lit("\n\n```py\nx = "), "doc_id", F.lit("\n```\n> said\n> "), "lang", F.lit("\n"))
    return src.parse_markdown(d.select("doc_id", body.alias("body")), "doc_id", "body").select("doc_id", "type", "text", "level")


@query("S6_markdown_of_documents")
def s6_documents(spark, sf_dir):
    return src.parse_markdown(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pos", "type", "text")


@query("S7_html_paragraphs", "SELECT page_id, count(*) AS paragraphs FROM (SELECT page_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|<img\\b[^>]*>', '', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</?(?:p|div|h[1-6]|li|ul|ol|table|tr|article|section|header|footer|nav|body|html|head|title|blockquote|pre)\\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g'), '\\n{2,}')) AS t FROM pages) WHERE trim(regexp_replace(t, '\\s+', ' ', 'g')) <> '' GROUP BY 1")
def s7(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(src.html_paragraphs(F.col("html"))).cast("long").alias("paragraphs"))


@query("S10_thread_items", "SELECT CASE WHEN turn = 0 THEN 'thread:' || conv_id ELSE 'thread:' || conv_id || '#' || turn END AS identity, 'thread:' || conv_id AS root_identity, CASE WHEN turn = 0 THEN 'discussion' ELSE 'discussion_comment' END AS kind, role AS author, length(text) AS chars FROM conversations", ints=("chars",))
def s10(spark, sf_dir):
    return src.thread_items(table(spark, sf_dir, "conversations"))


@query("S11_page_collector", "SELECT count(*) AS items, max(ts) AS cursor FROM events WHERE event_type <> 'signup' AND ts <= TIMESTAMP '2024-01-25'")
def s11(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'signup' AND ts <= timestamp'2024-01-25'")
    return e.agg(F.count("*").alias("items"), F.max("ts").alias("cursor"))


@query("X33_json_decode", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) >= 90 AS out_of_range FROM events")
def x33(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", "p.k", (F.col("p.k") >= 90).alias("out_of_range"))


CLAIM = Record({"lang": Text(choices=("en", "de", "es")), "text": Text(2_000), "evidence": Listed(Record({"sourceItemId": Text(20), "excerpt": Text(60)}), 1, 1), "note": Text(40)}, frozenset({"note"}))


@query(
    "X33_issue_lists",
    r"""WITH j AS (SELECT doc_id, '{"lang":"' || lang || '","text":"' || replace(text, chr(10), '\n') || '","evidence":[{"sourceItemId":"' || (doc_id + length(text) % 2) || '","excerpt":"' || replace(text[1:50], chr(10), '\n') || '"}],"' || CASE WHEN length(text) % 5 = 0 THEN 'other' ELSE 'note' END || '":"' || source || '"}' AS body FROM documents),
    v AS (SELECT doc_id, coalesce(json_valid(body), false) AS ok, CASE WHEN json_valid(body) THEN body END AS b FROM j),
    x AS (SELECT doc_id, ok, b ->> '$.lang' AS lang, regexp_replace(b ->> '$.text', '^\s+|\s+$', '', 'g') AS t, regexp_replace(b ->> '$.evidence[0].excerpt', '^\s+|\s+$', '', 'g') AS e, b ->> '$.note' AS note, b ->> '$.other' AS other FROM v),
    i AS (SELECT x.doc_id, x.doc_id + (SELECT length(d.text) % 2 FROM documents d WHERE d.doc_id = x.doc_id) AS ref, CASE WHEN NOT ok THEN ':invalid_json' ELSE concat_ws(',', CASE WHEN lang NOT IN ('en', 'de', 'es') THEN 'lang:choice' END, CASE WHEN t = '' THEN 'text:short' WHEN length(t) > 2000 THEN 'text:long' END, CASE WHEN e = '' THEN 'evidence.0.excerpt:short' END, CASE WHEN length(trim(note)) > 40 THEN 'note:long' WHEN trim(note) = '' THEN 'note:short' END, CASE WHEN other IS NOT NULL THEN ':unknown_key' END) END AS issues, e FROM x)
    SELECT i.doc_id, CASE WHEN issues <> '' THEN issues WHEN d.doc_id IS NULL THEN ref || ':unknown_reference' WHEN NOT coalesce(contains(d.text, e), false) THEN ref || ':excerpt_mismatch' ELSE '' END AS issues FROM i LEFT JOIN documents d ON d.doc_id = ref""",
)
def x33_issues(spark, sf_dir):
    """A response a document, with its text between quotes and only line ends escaped (so some are no JSON), that quotes its start from itself or the next one."""
    d = table(spark, sf_dir, "documents")
    line = lambda c: F.replace(c, F.lit("\n"), F.lit("\\n"))
    body = F.concat(F.lit('{"lang":"'), "lang", F.lit('","text":"'), line(F.col("text")), F.lit('","evidence":[{"sourceItemId":"'), F.col("doc_id") + F.length("text") % 2, F.lit('","excerpt":"'), line(F.substring("text", 1, 50)), F.lit('"}],"'), F.when(F.length("text") % 5 == 0, "other").otherwise("note"), F.lit('":"'), "source", F.lit('"}'))
    made = d.select("doc_id", body.alias("body"))
    got = responses.decoded(made, d, "doc_id", "body", "doc_id", "text", CLAIM, lambda v: responses.references(v, ("evidence",), (), ()))
    return got.select("doc_id", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["path"], x["problem"])), ",").alias("issues"))

"""Scalar functions and sanitiser steps over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import arrays, text, urls
from tarnwork.operators import privacy
from tarnwork.plans.catalog import query, table

#: Texts with identifiers and transient parts, made from columns of each document.
_TECH = "concat('Error ERR_', upper(source), ' TS', cast(1000 + doc_id as varchar), ' ENOENT ab-', cast(10 + doc_id % 90 as varchar), ' at /home/u', cast(doc_id % 7 as varchar), '/', lang, '/x.ts:12:3 in io.', 'MyTypeError 2024-01-02T03:04:05Z session id: 0123456789abcdef', ' ', lang, ' Fetch_ERROR FETCH_ERROR')"
_TECH_SPARK = _TECH.replace("as varchar", "as string")


@query("X1_normalize_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS inline_text FROM documents")
def x1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_inline(F.col("text")).alias("inline_text"))


@query("X2_slug", "SELECT part.p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def x2(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_type", F.lit(" / "), "p_brand")).alias("slug"))


@query("X3_package_name", "SELECT p_partkey, CASE WHEN (CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'maven' ELSE 'go' END) IN ('npm','jsr','pypi','nuget','crates-io') THEN lower(trim(p_name)) ELSE trim(p_name) END AS name FROM part")
def x3(spark, sf_dir):
    eco = F.element_at(F.array(*map(F.lit, ("npm", "pypi", "maven", "go"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.package_name(eco, F.col("p_name")).alias("name"))


_URL_SQL = """SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
  CASE WHEN u LIKE 'https:%' THEN regexp_replace(lower(regexp_extract(u, '^[^:/]+://([^/?]*)', 1)), ':443$', '') ELSE regexp_replace(lower(regexp_extract(u, '^[^:/]+://([^/?]*)', 1)), ':80$', '') END ||
  CASE WHEN regexp_replace(regexp_extract(u, '^[^:/]+://[^/?]*([^?]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(u, '^[^:/]+://[^/?]*([^?]*)', 1), '/+$', '') END ||
  regexp_extract(u, '^[^?]*(\\?.*)$', 1) AS url
  FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)"""


@query("X4_normalize_url", _URL_SQL)
def x4(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query("X5_iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor(extract('microseconds' FROM ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM events")
def x5(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.iso_timestamp(F.col("ts")).alias("iso"))


@query("X6_versioned_key", "SELECT doc_id, sha256('[1,' || CAST(to_json(source) AS VARCHAR) || ',' || CAST(to_json(lang) AS VARCHAR) || ',' || CAST(to_json(CAST(n_chars AS VARCHAR)) AS VARCHAR) || ']') AS key FROM documents")
def x6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.versioned_key(F.col("source"), F.col("lang"), F.col("n_chars").cast("string")).alias("key"))


@query("X7_stable_json_digest", """SELECT doc_id, sha256('{"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || ',"source":"' || source || '"}') AS digest FROM documents""")
def x7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.to_json(F.struct("lang", "n_chars", "source")).cast("binary"), 256).alias("digest"))


@query("X8_query_error_text", f"SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(t, '\\b(?:[a-z]:)?[\\\\/](?:users|home|tmp|private|var|data)[\\\\/][^\\s:]+', '<path>', 'gi'), ':\\d+(?::\\d+)?\\b', ':<line>', 'g'), '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}[T ][0-9:.+-]+Z?\\b', '<timestamp>', 'gi')) AS err FROM (SELECT doc_id, 'x' || replace({_TECH}, ' at /', ' at:x/') AS t FROM documents)")
def x8(spark, sf_dir):
    raw = F.expr(f"concat('x', replace({_TECH_SPARK}, ' at /', ' at:x/'))")
    return table(spark, sf_dir, "documents").select("doc_id", text.error_text(raw).alias("err"))


_CODES = "list_distinct(list_transform(list_concat(regexp_extract_all(t, '\\b(?:ERR_[A-Z0-9_]+|TS\\d{3,5}|[A-Z]{2,}-\\d{2,})\\b', 0, 'i'), regexp_extract_all(t, '\\bE[A-Z]{2,10}\\b')), lambda x: lower(x)))"


@query("X9_query_error_codes", f"SELECT doc_id, unnest(list_sort({_CODES})) AS code FROM (SELECT doc_id, {_TECH} AS t FROM documents)")
def x9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.query_error_codes(F.expr(_TECH_SPARK))).alias("code"))


@query(
    "X10_projection_codes",
    f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '\\b(?:ERR_[A-Z0-9_]+|E[A-Z]{{2,10}}|TS\\d{{3,5}}|[A-Z]{{2,}}-\\d{{2,}})\\b'), lambda x: x))), ',').lower() AS codes, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\b(?:[A-Za-z_$][\\w$]*\\.)*[A-Za-z_$][\\w$]*(?:Error|Exception)\\b'))), ',').lower() AS classes FROM (SELECT doc_id, {_TECH} AS t FROM documents)",
)
def x10(spark, sf_dir):
    t = F.expr(_TECH_SPARK)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.projection_error_codes(t), ",").alias("codes"), F.array_join(text.projection_exception_classes(t), ",").alias("classes"))


@query(
    "X11_technical_text",
    f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(t), '(?:/users/[^\\s/]+|/home/[^\\s/]+|/tmp|/private/var/folders|/var/folders)/[^\\s\"''`]+', '<path>', 'g'), '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}[t ][0-2]\\d:[0-5]\\d:[0-5]\\d(?:\\.\\d+)?(?:z|[+-]\\d{{2}}:?\\d{{2}})\\b', '<timestamp>', 'g'), '\\b(build|request|trace|session|correlation)[-_ ]?id\\s*[:=]\\s*[0-9a-f-]{{16,}}\\b', '\\1-id:<id>', 'g') AS tech, 'normalized_contextual_identifier,normalized_posix_transient_path,normalized_timestamp' AS reasons FROM (SELECT doc_id, {_TECH} AS t FROM documents)",
)
def x11(spark, sf_dir):
    out, reasons = text.technical_text(F.expr(_TECH_SPARK))
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("tech"), F.array_join(reasons, ",").alias("reasons"))


@query(
    "X12_profile_codes",
    f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '\\b(?:ERR_[A-Z0-9_]+|TS\\d{{3,5}}|EAS_[A-Z0-9_]+|[A-Z][A-Z0-9_]{{2,}}_ERROR|E[A-Z]{{2,}}\\d*)\\b'), lambda x: upper(x)))), ',') AS codes, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\b(?:(?:[A-Za-z_$][\\w$]*)\\.)*[A-Z][A-Za-z0-9_$]*(?:Error|Exception)\\b'))), ',') AS classes FROM (SELECT doc_id, {_TECH} AS t FROM documents)",
)
def x12(spark, sf_dir):
    t = F.expr(_TECH_SPARK)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.profile_error_codes(t), ",").alias("codes"), F.array_join(text.profile_exception_classes(t), ",").alias("classes"))


_TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9_@./<>:-]+'), lambda x: length(x) > 1)"
_SHINGLES = "list_sort(list_transform(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END), lambda x: sha256(x)))"


@query("X13_token_shingles", f"SELECT item_id, unnest({_SHINGLES}) AS shingle FROM (SELECT item_id, {_TOKENS.format(c='text')} AS w FROM benchmark)")
def x13(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.shingles(F.lower("text"))).alias("shingle"))


_PAIR = "FROM (SELECT a.doc_id, list_transform(string_split(lower(a.text), ' ')[1:30], lambda x: x) AS l, string_split(lower(b.text), ' ')[1:40] AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def _pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    left = docs.select("doc_id", F.slice("w", 1, 30).alias("l"))
    return left.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.slice("w", 1, 40).alias("r")), "doc_id")


@query(
    "X14_set_similarities",
    f"SELECT doc_id, round(len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r))), 6) AS jaccard, round(len(list_intersect(l, r)) / least(len(list_distinct(l)), len(list_distinct(r))), 6) AS overlap {_PAIR}",
)
def x14(spark, sf_dir):
    a, b = F.col("l"), F.col("r")
    return _pairs(spark, sf_dir).select("doc_id", F.round(arrays.jaccard(a, b), 6).alias("jaccard"), F.round(arrays.overlap_coefficient(a, b), 6).alias("overlap"))


@query("X15_listed_overlap", f"SELECT doc_id, round(len(list_filter(l, lambda x: list_contains(r, x))) / greatest(len(l), len(r)), 6) AS overlap {_PAIR}")
def x15(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", F.round(arrays.listed_overlap(F.col("l"), F.col("r")), 6).alias("overlap"))


@query(
    "X16_cosine",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def x16(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(arrays.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query(
    "X19_major_compatibility",
    "SELECT l_orderkey, l_linenumber, regexp_extract('v' || CAST(l_quantity AS INT) || '.1', '(?:^|[^0-9])(\\d+)(?:\\.\\d+)?', 1) AS major, CAST(l_quantity AS INT) = l_suppkey % 50 AS compatible FROM lineitem",
)
def x19(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    mine = text.major(F.concat(F.lit("v"), F.col("l_quantity").cast("int"), F.lit(".1")))
    theirs = text.major(F.concat(F.lit("sdk "), (F.col("l_suppkey") % 50)))
    return li.select("l_orderkey", "l_linenumber", mine.alias("major"), F.arrays_overlap(F.array(mine), F.array(theirs)).alias("compatible"))


@query("X20_version_text", "SELECT p_partkey, regexp_replace(lower(trim(' V' || p_size || '.' || p_partkey || '-RC ')), '^v(\\d)', '\\1') AS version FROM part")
def x20(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.version_text(F.concat(F.lit(" V"), "p_size", F.lit("."), "p_partkey", F.lit("-RC "))).alias("version"))


@query(
    "X21_classify_document",
    "SELECT page_id, CASE WHEN regexp_matches(url, '/fr/', 'i') THEN 'migration_guide' WHEN regexp_matches(url, '[?]page=\\d', 'i') THEN 'release_note' WHEN regexp_matches(url, 'EXAMPLE\\.org', 'i') THEN 'upgrade_guide' ELSE 'guide' END AS kind FROM pages",
)
def x21(spark, sf_dir):
    rules = [("migration_guide", "/fr/"), ("release_note", r"[?]page=\d"), ("upgrade_guide", r"EXAMPLE\.org")]
    return table(spark, sf_dir, "pages").select("page_id", text.classify(F.col("url"), rules, "guide").alias("kind"))


@query(
    "X22_detect_versions",
    "SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(url, '/(\\d+)', 1), regexp_extract_all(url, 'page=(\\d+)', 1)))), ',') AS versions FROM pages",
)
def x22(spark, sf_dir):
    rules = [(r"/(\d+)", 1), (r"page=(\d+)", 1)]
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.detect_versions(F.col("url"), rules), ",").alias("versions"))


@query(
    "X23_allowed_urls",
    "SELECT page_id, starts_with(url, 'https://') AND regexp_extract(url, '^([^:/]+://[^/?]+)', 1) IN ('https://therin.example.net', 'https://thther.example.org') AND (regexp_extract(url, '^[^:/]+://[^/?#]*([^?#]*)', 1) = '/en' OR starts_with(regexp_extract(url, '^[^:/]+://[^/?#]*([^?#]*)', 1), '/en/')) AS ok FROM pages",
)
def x23(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.allowed(F.col("url"), ["https://therin.example.net", "https://thther.example.org"], ["/en"]).alias("ok"))


@query("X24_word_count", "SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS words FROM documents", ints=("words",))
def x24(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(
    "X29_titles_and_X30_token_estimates",
    "SELECT doc_id, CASE WHEN length(text) > 256 THEN text[1:253] || '...' ELSE text END AS title, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
)
def x29(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated_title(F.col("text")).alias("title"), text.token_estimate(F.col("text")).alias("tokens"))


@query("X32_excerpt_containment", "SELECT d.doc_id, b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def x32(spark, sf_dir):
    # the passages are a fixed benchmark, so each text is searched for all of them in one pass
    return privacy.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


@query(
    "X34_embedding_input",
    "SELECT doc_id, 'Ecosystem: ' || source || chr(10) || 'Language: ' || lang || chr(10) || 'Problem: ' || text AS input FROM documents",
)
def x34(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("\n", F.concat(F.lit("Ecosystem: "), "source"), F.concat(F.lit("Language: "), "lang"), F.concat(F.lit("Problem: "), "text")).alias("input"),
    )


@query("U2_sorted_distinct", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities FROM orders GROUP BY 1")
def u2(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(arrays.sorted_distinct(F.collect_set("o_orderpriority"), True), ",").alias("priorities"))


@query(
    "U3_ordered_distinct",
    "SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY 1",
)
def u3(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


@query(
    "U6_merge_ranges",
    """WITH r AS (SELECT l_orderkey, l_partkey % 100 AS s, l_partkey % 100 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
    m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r),
    g AS (SELECT *, sum(CASE WHEN upto IS NULL OR s > upto THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT l_orderkey, min(s) AS s, max(e) AS e FROM g GROUP BY l_orderkey, island""",
)
def u6(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct((F.col("l_partkey") % 100).alias("s"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")).alias("e")).alias("r"))
    merged = li.groupBy("l_orderkey").agg(arrays.merge_ranges(F.collect_list("r")).alias("m"))
    return merged.select("l_orderkey", F.inline("m"))


# sanitiser steps -------------------------------------------------------------------------------------------------

_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


_CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}\\x{feff}]"
_HOST = "(?i)\\b(?:https?://)?(?:[A-Za-z0-9-]+\\.)+(?:internal|corp|lan|local)(?::\\d{1,5})?\\b"
_IP = "\\b(?:10(?:\\.\\d{1,3}){3}|192\\.168(?:\\.\\d{1,3}){2}|172\\.(?:1[6-9]|2\\d|3[01])(?:\\.\\d{1,3}){2})\\b"
_REPOSITORY = "(?i)\\bhttps?://(?:github\\.com|gitlab\\.com|bitbucket\\.org)/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:\\.git)?\\b"
_INJECTION = (
    "\\bignore (?:all |any )?(?:previous|prior|system|developer) instructions\\b",
    "\\b(?:reveal|print|exfiltrate|send) (?:the )?(?:system prompt|credentials|secrets?|tokens?)\\b",
    "\\b(?:execute|call|invoke) (?:this |the )?(?:tool|command)\\b",
    "\\byou are now (?:the |an? )?",
    "\\bdo not treat (?:this|the following) as data\\b",
)
_SECRET = "\\b(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{36})\\b"


@query("P1_controls", f"SELECT doc_id, len(regexp_extract_all(text, '{_CONTROL}')) AS n, md5(regexp_replace(text, '{_CONTROL}', '', 'g')) AS cleaned FROM documents", ints=("n",))
def p1(spark, sf_dir):
    out = privacy.step(table(spark, sf_dir, "documents"), "control_character")
    return out.select("doc_id", F.col("found").alias("n"), F.md5(F.col("text").cast("binary")).alias("cleaned"))


@query(
    "P2_internal_identifiers",
    f"""SELECT doc_id, n1 + n2 + len(regexp_extract_all(t2, '{_REPOSITORY}')) AS found, md5(regexp_replace(t2, '{_REPOSITORY}', '[REDACTED_REPOSITORY]', 'g')) AS cleaned
    FROM (SELECT doc_id, n1, len(regexp_extract_all(t1, '{_IP}')) AS n2, regexp_replace(t1, '{_IP}', '[REDACTED_INTERNAL_HOST]', 'g') AS t2
      FROM (SELECT doc_id, len(regexp_extract_all(text, '{_HOST}')) AS n1, regexp_replace(text, '{_HOST}', '[REDACTED_INTERNAL_HOST]', 'g') AS t1 FROM documents))""",
    ints=("found",),
)
def p2(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("total"))
    for name in ("internal_host", "private_ip", "repository_url"):
        out = privacy.step(out, name).withColumn("total", F.col("total") + F.col("found")).drop("found")
    return out.select("doc_id", F.col("total").alias("found"), F.md5(F.col("text").cast("binary")).alias("cleaned"))


@query("P4_emails", f"SELECT doc_id, len(regexp_extract_all(text, '\\b{_MAIL}\\b')) AS n, md5(regexp_replace(text, '\\b{_MAIL}\\b', '[REDACTED_EMAIL]', 'g')) AS cleaned FROM documents", ints=("n",))
def p4(spark, sf_dir):
    out = privacy.step(table(spark, sf_dir, "documents"), "email")
    return out.select("doc_id", F.col("found").alias("n"), F.md5(F.col("text").cast("binary")).alias("cleaned"))


_HITS = " + ".join(f"CAST(regexp_matches(text, '{p}', 'i') AS INTEGER)" for p in _INJECTION)


@query("P5_prompt_injection", f"SELECT doc_id, {_HITS} AS hits, {_HITS} > 0 AS quarantined FROM documents", ints=("hits",))
def p5(spark, sf_dir):
    hits = privacy.injection_hits(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"), (hits > 0).alias("quarantined"))


@query("P6_private_keys", f"SELECT doc_id, regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(text, '{_SECRET}') AS rejected FROM documents")
def p6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", privacy.residual_secret(F.col("text")).alias("rejected"))


_CODELIKE = "^\\s*(?:import |export |class |function |const |let |var |interface |type |[{}]|</?[A-Za-z])"


@query("P7_excessive_source", f"SELECT doc_id, len(string_split(text, chr(10))) > 40 OR (len(string_split(text, chr(10))) >= 12 AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_CODELIKE}'))) >= 10) AS excessive FROM documents")
def p7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", privacy.excessive_source(F.col("text")).alias("excessive"))


@query("P8_redaction_ratio", f"SELECT doc_id, greatest(0, length(text) - length(regexp_replace(text, '\\b{_MAIL}\\b', '', 'g'))) > 0.6 * length(text) AS rejected FROM documents")
def p8(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cleaned = F.regexp_replace("text", privacy.PATTERNS["email"][0], "")
    return d.select("doc_id", privacy.mostly_redacted(F.length("text"), F.length(cleaned)).alias("rejected"))


_KEYS = "(?:token|key|api_key|apikey|secret|password|signature|credential)"
#: What each step of the sanitiser looks for and puts in, as SQL.
_STEP_SQL = {
    "control_character": (_CONTROL, ""),
    "internal_host": (_HOST, "[REDACTED_INTERNAL_HOST]"),
    "private_ip": (_IP, "[REDACTED_INTERNAL_HOST]"),
    "repository_url": (_REPOSITORY, "[REDACTED_REPOSITORY]"),
    "secret": (_SECRET + "|-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_SECRET]"),
    "email": (f"\\b{_MAIL}\\b", "[REDACTED_EMAIL]"),
    "unix_home": ("/(?:Users|home)/[^/\\s]+", "$HOME"),
    "windows_home": ("[A-Za-z]:\\\\Users\\\\[^\\\\\\s]+", "$HOME"),
    "credential_url": ("(?i)\\b((?:https?|ssh|git|mongodb(?:\\+srv)?)://)[^\\s/@:]+:[^\\s/@]+@", "\\1"),
    "sensitive_query": (f"(?i)([?&]{_KEYS}=)[^&#\\s]+", "\\1[REDACTED]"),
}
_SPACES = "[\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _sanitized(name, keys, steps):
    rows = f"SELECT {keys}, text AS raw, text AS t FROM {name}"
    for s in steps:
        pattern, put = _STEP_SQL[s]
        rows = f"SELECT * REPLACE (regexp_replace(t, '{pattern}', '{put}', 'g') AS t), coalesce(len(regexp_extract_all(t, '{pattern}')), 0) AS n_{s} FROM ({rows})"
    lines = "string_split(t, chr(10))"
    bad = f"regexp_matches(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(t, '{_SECRET}') OR len({lines}) > 40 OR (len({lines}) >= 12 AND len(list_filter({lines}, lambda x: regexp_matches(x, '{_CODELIKE}'))) >= 10) OR greatest(0, length(raw) - length(t)) > 0.6 * length(raw)"
    status = f"CASE WHEN {bad} THEN 'rejected' WHEN {_HITS.replace('(text,', '(t,')} > 0 THEN 'quarantined' WHEN {' + '.join(f'n_{s}' for s in steps)} > 0 THEN 'sanitized' ELSE 'clean' END"
    return f"SELECT {keys}, regexp_replace(t, '^{_SPACES}+|{_SPACES}+$', '', 'g') AS text, {', '.join(f'n_{s}' for s in steps)}, {status} AS status FROM ({rows})"


@query("P3_sanitize_documents", _sanitized("documents", "doc_id", privacy.STEPS), ints=tuple(f"n_{s}" for s in privacy.STEPS))
def p3(spark, sf_dir):
    return privacy.sanitize(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("P9_short_text_variant", _sanitized("conversations", "conv_id, turn", privacy.SHORT_STEPS), ints=tuple(f"n_{s}" for s in privacy.SHORT_STEPS))
def p9(spark, sf_dir):
    return privacy.sanitize(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), privacy.SHORT_STEPS)


@query("A20_finding_counts", f"SELECT 'email' AS category, CAST(sum(len(regexp_extract_all(text, '\\b{_MAIL}\\b'))) AS BIGINT) AS findings, count(*) FILTER (WHERE regexp_matches(text, '\\b{_MAIL}\\b')) AS documents FROM documents")
def a20(spark, sf_dir):
    return privacy.finding_counts(table(spark, sf_dir, "documents"), ["email"])

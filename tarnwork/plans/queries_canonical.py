"""Candidate pairs among documents, and canonical records over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.operators import canonical, records
from tarnwork.plans.catalog import query, table

_TOK = "list_filter(regexp_split_to_array({0}, '[^a-z0-9_@./<>:-]+'), lambda x: length(x) > 1)"
_SH = "list_transform(list_distinct(CASE WHEN len({0}) >= 3 THEN list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i+1] || ' ' || {0}[i+2]) WHEN len({0}) > 0 THEN [array_to_string({0}, ' ')] ELSE CAST([] AS VARCHAR[]) END), lambda x: sha256(x))"
_CLEAN = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_WORDS = "list_filter(list_distinct(regexp_split_to_array({0}, '[^a-z0-9_]+')), lambda x: length(x) > 2)"
#: Profiles of documents: the first line as the problem, the rest as the solution, the last of several lines as the
#: root cause, numbers with a point as versions, and the first line that has one as the error.
_PROF = f"""(SELECT doc_id AS candidate_id, source AS ecosystem, lang AS platform, problem, solution, sha256(problem || chr(10) || solution) AS fingerprint, {_SH.format("pw")} AS ps, {_SH.format("sw")} AS ss, CASE WHEN cause <> '' THEN {_WORDS.format("cause")} END AS rw, list_distinct(list_transform(versions, lambda v: regexp_extract(v, '^[0-9]+'))) AS majors, CASE WHEN error <> '' THEN sha256(error) END AS error_fingerprint
  FROM (SELECT *, {_TOK.format("problem")} AS pw, {_TOK.format("solution")} AS sw FROM (SELECT doc_id, lang AS source, lang, {_CLEAN.format("split_part(text, chr(10), 1)")} AS problem, {_CLEAN.format("text[length(split_part(text, chr(10), 1)) + 2:]")} AS solution, {_CLEAN.format("CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), -1) END")} AS cause, regexp_extract_all(text, '[0-9]+\\.[0-9]+') AS versions, {_CLEAN.format("list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]\\.[0-9]'))[1]")} AS error FROM documents)))"""


def found(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    return canonical.profiles(
        d.select(
            F.col("doc_id").alias("candidate_id"),
            F.col("lang").alias("ecosystem"),
            F.array(F.lit("p")).alias("packages"),
            F.array("lang").alias("platforms"),
            F.substring_index("text", "\n", 1).alias("problem"),
            F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("solution"),
            F.when(F.size(lines) > 1, F.element_at(lines, -1)).alias("root_cause"),
            F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0)).alias("versions"),
            F.get(F.filter(lines, lambda x: x.rlike(r"[0-9]\.[0-9]")), F.lit(0)).alias("error"),
        )
    )


@query("R9_similarity_profiles", f"SELECT candidate_id, fingerprint, len(ps) AS problem_shingles, len(ss) AS solution_shingles, sha256(array_to_string(list_sort(ps), ',')) AS problem_digest FROM {_PROF}", ints=("problem_shingles", "solution_shingles",))
def r9(spark, sf_dir):
    p = found(spark, sf_dir)
    return p.select("candidate_id", "fingerprint", F.size("problem_shingles").alias("problem_shingles"), F.size("solution_shingles").alias("solution_shingles"), F.sha2(F.array_join("problem_shingles", ",").cast("binary"), 256).alias("problem_digest"))


_KEYS = f"""(SELECT candidate_id, unnest(list_concat(list_concat(list_concat(['same|' || ecosystem || '|' || fingerprint], CASE WHEN error_fingerprint IS NOT NULL THEN ['error|' || ecosystem || '|' || error_fingerprint] ELSE [] END), list_transform(list_sort(ps)[1:24], lambda s: 'problem|' || ecosystem || '|' || platform || '|' || s)), list_transform(list_sort(ss)[1:24], lambda s: 'solution|' || ecosystem || '|' || platform || '|' || s))) AS key FROM {_PROF})"""
_PAIRS = f"(SELECT DISTINCT a.candidate_id AS left_id, b.candidate_id AS right_id FROM {_KEYS} a JOIN {_KEYS} b ON a.key = b.key AND a.candidate_id < b.candidate_id)"
_JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE) END"
_CMP = f"""(SELECT left_id, right_id, l.fingerprint = r.fingerprint AS same, coalesce(l.error_fingerprint = r.error_fingerprint, false) AS same_error, {_JAC.format("l.ps", "r.ps")} AS problem, {_JAC.format("l.ss", "r.ss")} AS solution,
  concat_ws(',', CASE WHEN l.ecosystem <> r.ecosystem THEN 'incompatible_ecosystem' END, CASE WHEN l.platform <> r.platform THEN 'incompatible_platform' END, CASE WHEN len(l.majors) > 0 AND len(r.majors) > 0 AND len(list_intersect(l.majors, r.majors)) = 0 THEN 'incompatible_explicit_version' END, CASE WHEN l.rw IS NOT NULL AND r.rw IS NOT NULL AND {_JAC.format("l.rw", "r.rw")} < 0.15 THEN 'conflicting_root_cause' END) AS hard
  FROM {_PAIRS} p JOIN {_PROF} l ON l.candidate_id = p.left_id JOIN {_PROF} r ON r.candidate_id = p.right_id)"""


@query("J5_blocking_pairs", f"SELECT left_id, right_id FROM {_PAIRS}")
def j5(spark, sf_dir):
    return canonical.blocked_pairs(found(spark, sf_dir))


@query("R10_pair_comparison", f"SELECT left_id, right_id, same, same_error, hard, round(problem, 6) AS problem, round(solution, 6) AS solution FROM {_CMP}")
def r10(spark, sf_dir):
    got = canonical.blocked_comparisons(canonical.slim(found(spark, sf_dir), stored=False))
    return got.select("left_id", "right_id", "same", "same_error", F.array_join("hard", ",").alias("hard"), F.round("problem", 6).alias("problem"), F.round("solution", 6).alias("solution"))


_DEC = f"(SELECT left_id, right_id, CASE WHEN hard <> '' THEN 'separate' WHEN (same OR same_error) AND problem >= 0.72 AND solution >= 0.78 THEN 'auto_merge' ELSE 'review' END AS decision FROM {_CMP})"


def decided(spark, sf_dir):
    got = canonical.blocked_comparisons(canonical.slim(found(spark, sf_dir), stored=False))
    c = F.col
    return got.select("left_id", "right_id", canonical.decision(c("hard"), c("same"), c("same_error"), c("errors"), c("packages"), c("problem"), c("solution")).alias("decision"))


@query("R11_pair_decisions", f"SELECT left_id, right_id, decision FROM {_DEC}")
def r11(spark, sf_dir):
    return decided(spark, sf_dir)


@query("R15_first_merges", f"SELECT right_id AS candidate_id, min(left_id) AS \"into\" FROM {_DEC} WHERE decision = 'auto_merge' GROUP BY 1")
def r15(spark, sf_dir):
    return canonical.first_merges(canonical.slim(found(spark, sf_dir)))


@query(
    "R15_membership_events",
    """SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY candidate_id) AS sequence, candidate_id, event FROM (SELECT candidate_id, coalesce(n, o) AS record_id, CASE WHEN o IS NULL THEN 'attached' WHEN n IS NULL THEN 'split' WHEN o <> n THEN 'reassigned' END AS event FROM (SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 50 END AS o, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 40 ELSE o_custkey % 50 END END AS n FROM orders)) WHERE event IS NOT NULL AND NOT (record_id IS NULL)""", ints=("sequence",))
def r15_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_custkey") % 50).alias("record_id"))
    after = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 40).otherwise(F.col("o_custkey") % 50).alias("record_id"))
    return canonical.membership_events(before, after)


@query(
    "R15_membership_changes",
    """WITH ev AS (SELECT l_orderkey AS c, l_linenumber AS n, CASE WHEN l_linenumber = 7 THEN 'conflict' WHEN l_returnflag = 'R' THEN 'split' WHEN l_returnflag = 'A' THEN 'reassign' ELSE 'attach' END AS kind, l_suppkey % 60 AS r FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
before AS (SELECT o_orderkey AS c, CAST(o_custkey % 50 AS BIGINT) AS r FROM orders WHERE o_orderkey % 5 <> 0),
codes AS (SELECT c, list(CAST(CASE kind WHEN 'attach' THEN r WHEN 'reassign' THEN 1000 + r ELSE 2000 END AS BIGINT) ORDER BY n) AS es FROM ev WHERE kind <> 'conflict' GROUP BY 1),
state AS (SELECT c, list_reduce(list_prepend(coalesce(r, -1), coalesce(es, [])), lambda s, e: CASE WHEN e >= 2000 THEN -1 WHEN e >= 1000 THEN CASE WHEN s >= 0 THEN e - 1000 ELSE s END WHEN s >= 0 THEN s ELSE e END) AS r FROM before FULL JOIN codes USING (c)),
members AS (SELECT c, r, 1 AS own FROM state WHERE r >= 0 UNION ALL SELECT DISTINCT c, r, 0 FROM ev WHERE kind = 'conflict'),
known AS (SELECT r FROM before UNION SELECT r FROM ev)
SELECT known.r AS record_id, coalesce(sum(own), 0)::BIGINT AS supporting, count(*) FILTER (WHERE own = 0) AS conflicting, min(CASE WHEN own = 1 THEN c END) AS representative, CASE WHEN coalesce(sum(own), 0) > 0 THEN 'active' ELSE 'archived' END AS status FROM known LEFT JOIN members ON members.r = known.r GROUP BY 1""",
)
def r15_changes(spark, sf_dir):
    """A log of events on the memberships of orders; only records that it touches are rebuilt."""
    c, none = F.col, F.lit(None)
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")
    before = o.select(c("o_orderkey").cast("long").alias("candidate_id"), (c("o_custkey") % 50).cast("long").alias("record_id"), F.lit("supporting").alias("disposition"), F.lit("first").alias("solution_key"), none.cast("long").alias("since"), none.cast("long").alias("until"))
    kind = F.when(c("l_linenumber") == 7, "conflict").when(c("l_returnflag") == "R", "split").when(c("l_returnflag") == "A", "reassign").otherwise("attach")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(n).alias(n) for n in ("l_returnflag", "l_suppkey", "l_linestatus")])
    events = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("operation_id"), (c("l_orderkey") * 10 + c("l_linenumber")).cast("long").alias("sequence"), kind.alias("kind"), c("l_orderkey").cast("long").alias("candidate_id"), (c("l_suppkey") % 60).cast("long").alias("record_id"), c("l_linestatus").alias("solution_key"))
    change = records.changed(before, events)
    known = before.select("record_id").union(events.select("record_id"))
    kept = records.rebuilt(known, before).join(change.records.select("record_id"), "record_id", "left_anti")
    return kept.unionByName(change.records).drop("digest")


@query("A16_solution_groups", "SELECT l_partkey, l_returnflag AS solution_key, arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) AS representative, count(*) AS n, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS evidence FROM lineitem GROUP BY 1, 2")
def a16(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("solution_key"))
    return g.agg(F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"))).alias("representative"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("evidence"))


@query(
    "R14_canonical_projection",
    "SELECT source AS record_id, arg_min(doc_id, (-(n_chars % 101), length(text), doc_id)) AS representative, max(n_chars % 101) AS trust, count(*) AS members, array_to_string(list_sort(list_distinct(list(lang))), ',') AS variants, array_to_string(list_sort(list_distinct(list('c' || (doc_id % 4)))), ',') AS caveats FROM documents GROUP BY 1",
)
def r14(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    m = d.select(F.col("source").alias("record_id"), F.col("doc_id").alias("candidate_id"), (F.col("n_chars") % 101).alias("score"), F.col("text").alias("problem"), F.col("lang").alias("solution_key"), F.array(F.concat(F.lit("c"), F.col("doc_id") % 4)).alias("caveats"))
    got = canonical.project(m)
    return got.withColumns({"variants": F.array_join("variants", ","), "caveats": F.array_join("caveats", ",")})


@query("R19_candidate_assembly", "SELECT conv_id AS candidate_id, arg_min(text, turn) AS problem, arg_max(text, turn) AS solution, count(*) FILTER (WHERE role = 'assistant') AS steps FROM conversations GROUP BY 1")
def r19(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("candidate_id")).agg(F.min_by("text", "turn").alias("problem"), F.max_by("text", "turn").alias("solution"), F.count_if(F.col("role") == "assistant").alias("steps"))



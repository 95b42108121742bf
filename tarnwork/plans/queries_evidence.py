"""Evidence scoring over threads and order lines; quality, routing and moderation of contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import scores
from tarnwork.operators import contributions, evidence
from tarnwork.plans.catalog import query, table
from tarnwork.plans.queries_outcomes import ORDERS_AS_OF, as_of

# A candidate for each order; its lines are evidence.
_SIG = """SELECT l_orderkey AS cand, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS grounded, max(CASE WHEN l_returnflag = 'R' AND l_quantity < 5 THEN 1 ELSE 0 END) AS self_rep, max(CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END) AS official, max(CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END) AS maintainer, max(CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END) AS accepted, max(CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END) AS author, max(CASE WHEN l_tax = 0.08 THEN 1 ELSE 0 END) AS merged, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS closed, sum(CASE WHEN l_discount = 0.1 THEN 1 ELSE 0 END) AS aconf, sum(CASE WHEN l_discount = 0.09 THEN 1 ELSE 0 END) AS cconf, count(DISTINCT CASE WHEN l_quantity > 48 THEN l_returnflag END) AS labels, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INT) ELSE 0 END) AS BIGINT) AS likes, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS dislikes, count(DISTINCT l_suppkey) AS roots FROM lineitem GROUP BY 1"""


def candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    col = F.col
    return li.groupBy(col("l_orderkey").alias("cand")).agg(
        flag(col("l_returnflag") != "R").alias("grounded"),
        flag((col("l_returnflag") == "R") & (col("l_quantity") < 5)).alias("self_rep"),
        flag(col("l_suppkey") % 9 == 0).alias("official"),
        flag(col("l_partkey") % 7 == 0).alias("maintainer"),
        flag(col("l_linenumber") == 5).alias("accepted"),
        flag(col("l_linenumber") == 6).alias("author"),
        flag(col("l_tax") == 0.08).alias("merged"),
        flag(col("l_linestatus") == "F").alias("closed"),
        F.count_if(col("l_discount") == 0.1).alias("aconf"),
        F.count_if(col("l_discount") == 0.09).alias("cconf"),
        F.countDistinct(F.when(col("l_quantity") > 48, col("l_returnflag"))).alias("labels"),
        F.sum(F.when(col("l_returnflag") == "N", col("l_quantity").cast("int")).otherwise(0)).alias("likes"),
        F.count_if(col("l_returnflag") == "R").alias("dislikes"),
        F.countDistinct("l_suppkey").alias("roots"),
    )


def found_signals(spark, sf_dir):
    present = {
        "grounded_extraction": "grounded",
        "agent_self_report": "self_rep",
        "official_solution_guidance": "official",
        "maintainer_solution": "maintainer",
        "accepted_discussion_answer": "accepted",
        "author_confirmed": "author",
        "merged_closing_pull_request": "merged",
        "closed_after_solution": "closed",
        "authoritative_conflict": "aconf",
        "community_conflict": "cconf",
        "unsupported_candidate_label": "labels",
    }
    return evidence.signals(candidates(spark, sf_dir), "cand", {k: F.col(v) for k, v in present.items()}, F.col("likes"), F.col("dislikes"), F.col("roots"))


_EVID = f"""WITH s AS ({_SIG}), p AS (SELECT *, grounded*20 + self_rep*5 + official*40 + maintainer*28 + accepted*24 + author*20 + merged*15 + closed*5 + CASE WHEN likes > 0 THEN least(6, CAST(floor(log2(likes+1)*2) AS INT)) ELSE 0 END + CASE WHEN roots >= 2 THEN least(15, (roots-1)*5) ELSE 0 END AS positive,
 -(aconf*35 + cconf*15 + labels*10 + CASE WHEN dislikes > 0 THEN least(6, CAST(floor(log2(dislikes+1)*2) AS INT)) ELSE 0 END) AS negative, official + maintainer + accepted + author + merged AS strong, official AS decisive FROM s),
e AS (SELECT *, CASE WHEN strong = 0 THEN least(55, greatest(0, least(100, positive + negative))) ELSE greatest(0, least(100, positive + negative)) END AS source FROM p)"""


@query("R2_evidence_signals", f"WITH s AS ({_SIG}) SELECT signal, n, CAST(points AS BIGINT) AS points FROM (SELECT 'grounded_extraction' AS signal, count(*) AS n, 20 * count(*) AS points FROM s WHERE grounded = 1 UNION ALL SELECT 'authoritative_conflict', count(*), -35 * sum(aconf) FROM s WHERE aconf > 0 UNION ALL SELECT 'independent_source_convergence', count(*), sum(least(15, (roots-1)*5)) FROM s WHERE roots >= 2 UNION ALL SELECT 'unsupported_candidate_label', count(*), -10 * sum(labels) FROM s WHERE labels > 0)")
def r2(spark, sf_dir):
    g = found_signals(spark, sf_dir).groupBy("signal").agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    return g.where(F.col("signal").isin("grounded_extraction", "authoritative_conflict", "independent_source_convergence", "unsupported_candidate_label"))


@query("A12_signal_sums_and_R3_source_evidence", f"{_EVID} SELECT cand, CAST(positive AS INT) AS positive, CAST(negative AS INT) AS negative, strong = 0 AS weak, CAST(source AS INT) AS source FROM e")
def r3(spark, sf_dir):
    return evidence.source_evidence(found_signals(spark, sf_dir), "cand").select("cand", "positive", "negative", "weak", "source")


@query("A14_independent_roots", "SELECT role, count(DISTINCT conv_id) AS roots, CASE WHEN count(DISTINCT conv_id) >= 2 THEN least(15, (count(DISTINCT conv_id) - 1) * 5) ELSE 0 END AS points FROM conversations GROUP BY 1")
def a14(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("role").agg(F.countDistinct("conv_id").alias("roots"))
    return g.select("role", "roots", F.when(F.col("roots") >= 2, F.least(F.lit(15), (F.col("roots") - 1) * 5)).otherwise(0).alias("points"))


@query("R1_evidence_integrity", "SELECT l_orderkey, NOT bool_or(p.p_partkey IS NULL OR l_linestatus <> CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END OR l_returnflag = 'R') AS eligible, count(*) FILTER (WHERE p.p_partkey IS NULL OR l_linestatus <> CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END OR l_returnflag = 'R') AS broken FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 50 <> 0) p ON l_partkey = p_partkey GROUP BY 1")
def r1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linestatus").alias("visibility"), (F.col("l_returnflag") == "R").alias("digest"))
    items = table(spark, sf_dir, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 2 == 0, "F").otherwise("O").alias("item_visibility"), F.lit(False).alias("item_digest"))
    return evidence.integrity(li, items, "l_partkey", "l_orderkey")


@query("R4_version_fit", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 AND p_partkey % 3 > 0 THEN CASE WHEN p_size % 4 = p_partkey % 3 THEN 100 ELSE 10 END WHEN p_size % 4 > 0 OR p_partkey % 3 > 0 THEN 55 WHEN p_brand LIKE '%1' THEN 75 ELSE 40 END AS fit FROM part")
def r4(spark, sf_dir):
    a, b = F.col("p_size") % 4, (F.col("p_partkey") % 3).cast("int")
    none = F.array().cast("array<int>")
    return table(spark, sf_dir, "part").select("p_partkey", evidence.version_fit(F.when(a > 0, F.array(a)).otherwise(none), F.when(b > 0, F.array(b)).otherwise(none), F.col("p_brand").endswith("1")).alias("fit"))


@query(
    "R5_final_evidence_score",
    f"""{_EVID}, f AS (SELECT e.*, o_orderdate, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}')) AS age FROM e JOIN orders ON o_orderkey = cand),
    g AS (SELECT *, CASE WHEN age <= 180 THEN 100 ELSE greatest(0, CAST(floor(100 * pow(2.0, -(age - 180) / 365.0::DOUBLE) + 0.5) AS INT)) END AS fresh FROM f),
    r AS (SELECT *, CAST(floor((70 * source + 20 * fresh + 10 * CASE WHEN official = 1 THEN 75 ELSE 40 END) / 100.0::DOUBLE + 0.5) AS INT) AS raw FROM g),
    c AS (SELECT *, least(raw, CASE WHEN raw >= 85 AND decisive = 0 AND strong < 2 THEN 84 ELSE 100 END, CASE WHEN aconf > 0 THEN 69 ELSE 100 END, CASE WHEN age > 180 AND fresh < 50 THEN 69 ELSE 100 END, CASE WHEN self_rep > 0 THEN 34 ELSE 100 END) AS score FROM r)
    SELECT cand, score, CASE WHEN score < 25 THEN 'very_low' WHEN score < 50 THEN 'low' WHEN score < 70 THEN 'moderate' WHEN score < 85 THEN 'high' ELSE 'very_high' END AS grade FROM c""",
)
def r5(spark, sf_dir):
    src = evidence.source_evidence(found_signals(spark, sf_dir), "cand")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cand"), F.floor(scores.age_days(F.col("o_orderdate"), as_of(ORDERS_AS_OF))).cast("int").alias("age"))
    fresh, status = scores.freshness(F.greatest(F.lit(0), F.col("age")), F.lit(False))
    version = F.when(F.col("decisive") > 0, 75).otherwise(40)
    j = src.join(o, "cand").withColumns({"fresh": fresh, "stale": status == "stale", "version": version})
    c = F.col
    score = evidence.final_score(c("source"), c("fresh"), c("version"), c("strong"), c("decisive"), c("conflicts"), c("stale"), c("self_reports"))
    return j.select("cand", score.alias("score"), scores.grade(score).alias("grade"))


# contributions ---------------------------------------------------------------------------------------------------

_REL = "CASE o_orderkey % 6 WHEN 0 THEN 'novel' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'variant' WHEN 3 THEN 'correction' WHEN 4 THEN 'conflict' ELSE 'confirmation' END"


@query("R7_contribution_routing", f"SELECT o_orderkey, CASE WHEN rel = 'novel' THEN 'discover_novel' WHEN rel IN ('correction', 'conflict') THEN 'conflict_existing' ELSE 'support_existing' END AS mode, rel = 'variant' AS alternative FROM (SELECT o_orderkey, {_REL} AS rel FROM orders)")
def r7(spark, sf_dir):
    rel = F.expr(_REL)
    return table(spark, sf_dir, "orders").select("o_orderkey", contributions.route(rel).alias("mode"), contributions.is_alternative(rel).alias("alternative"))


_WORDS = "len(list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda x: x <> ''))"


@query(
    "R6_contribution_quality",
    f"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS problem, text[length(split_part(text, chr(10), 1)) + 2:] AS solution, lang, source, n_chars, CASE doc_id % 11 WHEN 0 THEN ' a missing semicolon' WHEN 1 THEN ' in our repo only' WHEN 2 THEN ' then rm -rf it' ELSE '' END AS extra FROM documents)
    SELECT doc_id, CASE WHEN {_WORDS.format("problem")} < 6 OR {_WORDS.format("solution")} < 6 OR doc_id % 13 = 0 OR doc_id % 11 IN (0, 1) THEN 'rejected' WHEN doc_id % 5 = 0 OR doc_id % 11 = 2 THEN 'review' ELSE 'eligible' END AS decision FROM d""",
)
def r6(spark, sf_dir):
    extra = F.when(F.col("doc_id") % 11 == 0, " a missing semicolon").when(F.col("doc_id") % 11 == 1, " in our repo only").when(F.col("doc_id") % 11 == 2, " then rm -rf it").otherwise("")
    problem, solution = F.substring_index("text", "\n", 1), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)")
    applies = F.when(F.col("doc_id") % 5 != 0, F.lit("when the cache is cold"))
    s = contributions.quality_signals(problem, F.lit(1), solution, F.lit(1), F.when(F.col("doc_id") % 13 == 0, 0).otherwise(1), applies, F.lit(1), F.lit("tests pass again"), F.concat_ws("\n", F.lit("x"), extra))
    return table(spark, sf_dir, "documents").select("doc_id", contributions.quality_decision(s).alias("decision"))


@query("R21_quality_gate", "SELECT decision, CASE WHEN decision = 'rejected' THEN 'quality_blocked' ELSE 'quality_assessed' END AS stage, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'eligible' WHEN 'P' THEN 'rejected' ELSE 'review' END AS decision FROM orders) GROUP BY 1, 2")
def r21(spark, sf_dir):
    decision = F.when(F.col("o_orderstatus") == "F", "eligible").when(F.col("o_orderstatus") == "P", "rejected").otherwise("review")
    return table(spark, sf_dir, "orders").select(decision.alias("decision"), contributions.gate(decision).alias("stage")).groupBy("decision", "stage").agg(F.count("*").alias("n"))


@query(
    "R22_moderation",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND (action <> 'approve' OR (o_custkey % 2 = 0 AND o_orderstatus <> 'P')) THEN CASE WHEN action IN ('approve', 'restore') THEN 'approved' WHEN action = 'reject' THEN 'rejected' ELSE 'flagged' END ELSE 'pending' END AS state FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'restore' WHEN 2 THEN 'reject' ELSE 'flag' END AS action FROM orders)",
)
def r22(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    action = F.element_at(F.array(*map(F.lit, ("approve", "restore", "reject", "flag"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    expected = F.when(F.col("o_orderkey") % 3 == 0, "stale").otherwise("pending")
    quality = F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("eligible")
    return o.select("o_orderkey", contributions.moderation(action, expected, F.lit("pending"), F.col("o_custkey") % 2 == 0, quality).alias("state"))


@query("R23_extraction_class", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'quarantined' WHEN status = 'reusable' AND n_chars < 500 THEN 'insufficient' ELSE status END AS class FROM (SELECT doc_id, n_chars, CASE lang WHEN 'en' THEN 'reusable' WHEN 'fr' THEN 'irrelevant' WHEN 'de' THEN 'insufficient' ELSE 'conflicting' END AS status FROM documents)")
def r23(spark, sf_dir):
    status = F.when(F.col("lang") == "en", "reusable").when(F.col("lang") == "fr", "irrelevant").when(F.col("lang") == "de", "insufficient").otherwise("conflicting")
    return table(spark, sf_dir, "documents").select("doc_id", contributions.extraction_class(F.col("doc_id") % 10 != 0, status, F.col("n_chars") >= 500).alias("class"))


@query("R24_public_share_gate", "SELECT o.o_orderkey, CASE WHEN o_custkey % 10 = o_orderkey % 10 OR c_acctbal > 5000 THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'quarantined' ELSE 'submitted' END ELSE 'denied' END AS state FROM orders o JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'AUTOMOBILE'")
def r24(spark, sf_dir):
    members = table(spark, sf_dir, "customer").where("c_mktsegment <> 'AUTOMOBILE'").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 5000).alias("member"))
    may = F.col("member") | (F.col("o_custkey") % 10 == F.col("o_orderkey") % 10)
    state = F.when(may, F.when(F.col("o_orderpriority").startswith("1"), "quarantined").otherwise("submitted")).otherwise("denied")
    return table(spark, sf_dir, "orders").join(members, "o_custkey").select("o_orderkey", state.alias("state"))


@query("R18_label_grounding", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE (l_returnflag = 'R' AND s_acctbal > 0) OR (l_returnflag = 'N' AND s_nationkey < 12) GROUP BY 1")
def r18(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal", "s_nationkey")
    ok = ((F.col("l_returnflag") == "R") & (F.col("s_acctbal") > 0)) | ((F.col("l_returnflag") == "N") & (F.col("s_nationkey") < 12))
    return li.join(sup, "l_suppkey").where(ok).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("labels"))

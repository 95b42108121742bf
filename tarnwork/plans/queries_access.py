"""Filters, joins, counts, latest rows and orders over the order and event tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwork.operators import access, tables
from tarnwork.plans.catalog import query, table

#: Orders as records: a third each public, private to the customer, and of a team.
_VIS = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'public' WHEN '2' THEN 'public' WHEN '3' THEN 'private' ELSE 'team' END"
_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'review' WHEN 2 THEN 'active' WHEN 3 THEN 'deprecated' ELSE 'archived' END"
_REC = f"(SELECT o_orderkey AS id, o_custkey AS owner_id, 'w' || (o_custkey % 10) AS workspace_id, {_VIS} AS visibility, {_STATUS} AS status, o_orderdate AS at, o_totalprice AS price FROM orders)"


def records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("owner_id"),
        F.concat(F.lit("w"), F.col("o_custkey") % 10).alias("workspace_id"),
        F.expr(_VIS).alias("visibility"),
        F.expr(_STATUS).alias("status"),
        F.col("o_orderdate").alias("at"),
        F.col("o_totalprice").alias("price"),
    )


@query("F1_access_predicate", f"SELECT id FROM {_REC} WHERE visibility = 'public' OR (visibility = 'private' AND owner_id = 77) OR (visibility = 'team' AND workspace_id = 'w3')")
def f1(spark, sf_dir):
    may = access.readable_by_any([{"scope": "public"}, {"scope": "private", "owner": 77}, {"scope": "team", "workspace": "w3"}])
    return records(spark, sf_dir).where(may).select("id")


@query("F2_lifecycle_access", f"SELECT id, status IN ('active','deprecated') AS public_ok, status IN ('draft','review','active','deprecated') AS review_ok FROM {_REC}")
def f2(spark, sf_dir):
    return records(spark, sf_dir).select("id", access.accessible_status("public").alias("public_ok"), access.accessible_status("review").alias("review_ok"))


@query("F4_admin_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001')")
def f4(spark, sf_dir):
    return access.admin_search(table(spark, sf_dir, "customer"), "00001", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("F5_keyset_page", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 500) ORDER BY ts DESC, event_id DESC LIMIT 51")
def f5(spark, sf_dir):
    boundary = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return access.page(table(spark, sf_dir, "events"), "ts", "event_id", 50, (boundary, 500)).select("event_id", "ts")


@query("F6_safe_outcomes", "SELECT user_id % 500 AS path, count(DISTINCT user_id) AS users, CASE WHEN count(DISTINCT user_id) < 3 THEN 'limited' ELSE 'observed' END AS status, CASE WHEN count(DISTINCT user_id) >= 3 THEN count(*) END AS reports FROM events GROUP BY 1")
def f6(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 500).alias("path")).agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))
    shown = F.col("users") >= 3
    return g.select("path", "users", F.when(shown, "observed").otherwise("limited").alias("status"), F.when(shown, F.col("n")).alias("reports"))


@query("F7_safe_provenance", "SELECT doc_id, text[1:500] AS title, source AS locator, text[1:1000] AS excerpt, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE source END AS authority FROM documents")
def f7(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.col("text").alias("title"), F.col("source").alias("locator"), F.col("text").alias("excerpt"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("authority"))
    return access.safe_provenance(rows)


@query("F8_solution_steps", "SELECT doc_id, i AS step, line[1:20000] AS instruction, line[1:5000] AS verification FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def f8(spark, sf_dir):
    steps = F.transform(F.split("text", "\n"), lambda s, i: F.struct((i + 1).cast("long").alias("step"), F.substring(s, 1, 20_000).alias("instruction"), F.substring(s, 1, 5_000).alias("verification")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(steps))


@query("F9_masked_titles", f"SELECT id, CASE WHEN visibility = 'private' THEN 'Private record ' || id ELSE status || ' ' || id END AS title FROM {_REC}")
def f9(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("id", access.masked_title(F.concat_ws(" ", "status", "id"), F.col("visibility"), "record", F.col("id")).alias("title"))


@query("F10_pending_work", f"SELECT id FROM {_REC} WHERE status IN ('draft', 'review') AND id % 3 <> 0")
def f10(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("assessment", F.when(F.col("id") % 3 == 0, F.col("price")))
    return r.where(F.col("status").isin("draft", "review") & F.col("assessment").isNull()).select("id")


@query("F11_approved_waiting", f"SELECT status, visibility, count(*) AS n FROM {_REC} WHERE status = 'active' AND visibility <> 'team' GROUP BY 1, 2")
def f11(spark, sf_dir):
    return records(spark, sf_dir).where((F.col("status") == "active") & F.col("visibility").isin("public", "private")).groupBy("status", "visibility").agg(F.count("*").alias("n"))


@query("F12_invariants", "SELECT vec_id, 'label_below_9' AS rule FROM embeddings WHERE NOT label < 9 UNION ALL SELECT vec_id, 'dimensions' FROM embeddings WHERE NOT len(embedding) = 64")
def f12(spark, sf_dir):
    return access.violations(table(spark, sf_dir, "embeddings"), {"dimensions": F.size("embedding") == 64, "label_below_9": F.col("label") < 9}, ["vec_id"])


@query("F13_compact_detail", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey))[1:5], ',') AS keys, count(*) > 5 AS truncated FROM orders GROUP BY 1")
def f13(spark, sf_dir):
    first = table(spark, sf_dir, "orders").withColumn("at", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("at <= 6")
    g = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))  # one more than is shown
    cut = g.select("o_custkey", *[c.alias(n) for n, c in access.compact({"keys": 5}).items()])
    return cut.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))


# joins -----------------------------------------------------------------------------------------------------------


@query("J1_references_to_items", "SELECT l.l_orderkey, count(*) AS refs, count(o.o_orderkey) AS found, count(DISTINCT l_suppkey) AS registries FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus <> 'P' GROUP BY 1")
def j1(spark, sf_dir):
    items = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("hit"))
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("refs"), F.countDistinct("l_suppkey").alias("registries"))
    return refs.join(items, "l_orderkey", "left").select("l_orderkey", "refs", F.when(F.col("hit") == 1, F.col("refs")).otherwise(0).alias("found"), "registries")


@query("J2_missing_references", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def j2(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return tables.missing(table(spark, sf_dir, "lineitem").select("l_partkey").distinct(), known, ["l_partkey"])


@query("J3_latest_root", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, length(arg_max(text, turn)) AS chars FROM conversations GROUP BY 1", ints=("chars",))
def j3(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    return tables.latest(rows, ["conv_id"], ["turn"], ["turn", "role", "chars"])


@query("J4_comment_to_root", "SELECT c.conv_id, c.turn, c.role = r.role AS same_author FROM conversations c JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = 0 WHERE c.turn > 0")
def j4(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    roots = c.where("turn = 0").select("conv_id", F.col("role").alias("root_role"))
    return c.where("turn > 0").join(roots, "conv_id").select("conv_id", "turn", (F.col("role") == F.col("root_role")).alias("same_author"))


@query("J6_provenance", "SELECT n.n_name, count(*) AS refs, CAST(sum(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal > 0 GROUP BY 1")
def j6(spark, sf_dir):
    # by supplier first: the joins then see a row for each supplier
    refs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("refs"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    sup = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return refs.join(sup, "l_suppkey").join(nat, "s_nationkey").groupBy("n_name").agg(F.sum("refs").alias("refs"), F.sum("quantity").alias("quantity"))


@query("J7_latest_assessment", "SELECT c.c_custkey, o.id, o.at FROM customer c LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id, max(o_orderdate) AS at FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def j7(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(tables.latest(o, ["c_custkey"], ["at", "id"], ["id", "at"]), "c_custkey", "left")


@query("J8_change_detection", "SELECT doc_id, CASE WHEN n = 1 THEN 'created' WHEN prev = digest THEN 'unchanged' ELSE 'updated' END AS change FROM (SELECT doc_id, md5(text) AS digest, lag(md5(text)) OVER w AS prev, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id))")
def j8(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))
    return tables.successive_changes(d, ["source", "lang"], ["doc_id"]).select("doc_id", "change")


@query("J9_deleted_from_index", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_type NOT LIKE 'PROMO%'")
def j9(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    states = table(spark, sf_dir, "part").where("p_type NOT LIKE 'PROMO%'").select("p_partkey")
    return tables.missing(states, seen, ["p_partkey"])


@query("J11_all_assessed", "SELECT o_custkey, min(o_orderstatus) = 'F' AND max(o_orderstatus) = 'F' AS all_completed, count(*) AS n FROM orders GROUP BY 1")
def j11(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_completed"), F.count("*").alias("n"))


@query("J13_existing_target", "SELECT o_custkey, arg_min(o_orderkey % 20, o_orderkey) AS target FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def j13(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min_by(F.col("o_orderkey") % 20, "o_orderkey").alias("target"))


@query(
    "J14_recent_search_by_user",
    "SELECT s.event_id, count(v.event_id) AS earlier FROM events s LEFT JOIN events v ON v.user_id = s.user_id AND v.event_type = 'view' AND v.ts >= s.ts - INTERVAL 2 HOUR AND v.ts <= s.ts + INTERVAL 60 SECOND WHERE s.event_type = 'purchase' GROUP BY 1",
)
def j14(spark, sf_dir):
    from tarnwork.plans.ranges import range_count

    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros("ts"))
    asked = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return range_count(asked, e.where("event_type = 'view'").select("user_id", "t"), ["user_id"], "t", 7_200_000_000, 60_000_000, "event_id", "earlier")


# counts ----------------------------------------------------------------------------------------------------------


@query("A1_search_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS selected FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def a1(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts >= timestamp'2024-01-10'").agg(F.count("*").alias("total"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("selected"))


@query(
    "A2_contribution_counts",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE visibility = 'public') AS public_n, count(*) FILTER (WHERE visibility = 'private') AS private_n, count(*) FILTER (WHERE visibility = 'team') AS team_n, count(*) FILTER (WHERE status = 'draft') AS draft_n, count(*) FILTER (WHERE status = 'review') AS review_n, count(*) FILTER (WHERE status = 'active') AS active_n, count(*) FILTER (WHERE status = 'deprecated') AS deprecated_n, count(*) FILTER (WHERE status = 'archived') AS archived_n FROM {_REC}",
)
def a2(spark, sf_dir):
    r = records(spark, sf_dir)
    by = [F.count_if(F.col("visibility") == v).alias(f"{v}_n") for v in ("public", "private", "team")]
    by += [F.count_if(F.col("status") == s).alias(f"{s}_n") for s in ("draft", "review", "active", "deprecated", "archived")]
    return r.agg(F.count("*").alias("total"), *by)


@query("A3_outcome_pivot", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def a3(spark, sf_dir):
    kinds = ("purchase", "click", "error", "signup", "view")
    return table(spark, sf_dir, "events").where("ts >= timestamp'2024-01-05'").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


@query("A13_reaction_totals", "SELECT path, count(*) FILTER (WHERE kind IN ('purchase', 'click')) AS positive, count(*) FILTER (WHERE kind = 'error') AS negative FROM (SELECT DISTINCT event_id % 50 AS path, user_id, event_type AS kind FROM events) GROUP BY 1")
def a13(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("path"), "user_id", F.col("event_type").alias("kind")).distinct()
    return e.groupBy("path").agg(F.count_if(F.col("kind").isin("purchase", "click")).alias("positive"), F.count_if(F.col("kind") == "error").alias("negative"))


@query("A15_membership_summary", f"SELECT owner_id, count(*) FILTER (WHERE status = 'active') AS supporting, count(*) FILTER (WHERE status = 'review') AS conflicting, count(*) FILTER (WHERE status = 'archived') AS rejected FROM {_REC} GROUP BY 1")
def a15(spark, sf_dir):
    kinds = {"supporting": "active", "conflicting": "review", "rejected": "archived"}
    return records(spark, sf_dir).groupBy("owner_id").agg(*[F.count_if(F.col("status") == s).alias(k) for k, s in kinds.items()])


@query(
    "A17_run_rollup",
    """SELECT run, total, CASE WHEN done + failed + stopped = total THEN CASE WHEN stopped > 0 THEN 'quarantined' WHEN failed > 0 THEN CASE WHEN done > 0 THEN 'partially_completed' ELSE 'failed' END ELSE 'completed' END WHEN active > 0 THEN 'running' ELSE 'queued' END AS status
    FROM (SELECT l_orderkey AS run, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R') AS done, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_quantity < 3 AND l_returnflag <> 'R' AND l_linestatus <> 'F') AS stopped, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag <> 'R' AND l_quantity >= 25) AS active FROM lineitem GROUP BY 1)""",
)
def a17(spark, sf_dir):
    from tarnwork.operators.jobs import run_status

    state = (
        F.when(F.col("l_returnflag") == "R", "failed")
        .when(F.col("l_linestatus") == "F", "completed")
        .when(F.col("l_quantity") < 3, "quarantined")
        .when(F.col("l_quantity") >= 25, "active")
        .otherwise("waiting")
    )
    return run_status(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), state.alias("status")), "run")


@query("A18_reaction_map", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS reactions FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def a18(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    m = n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("reactions"))


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("A19_overview_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def a19(spark, sf_dir):
    out = None
    for t in _COUNTED:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("A21_latest_use", "SELECT user_id, max(ts) AS last_used FROM events GROUP BY 1")
def a21(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_used"))


# latest rows and orders --------------------------------------------------------------------------------------------


@query("W1_latest_per_identity", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def w1(spark, sf_dir):
    return tables.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])


@query("W2_latest_then_failed", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND o_orderstatus = 'F'")
def w2(spark, sf_dir):
    got = tables.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return got.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")


@query("W3_latest_profile", "SELECT l_partkey, arg_max(l_orderkey * 10 + l_linenumber, (l_shipdate, -(l_orderkey * 10 + l_linenumber))) AS profile FROM lineitem GROUP BY 1")
def w3(spark, sf_dir):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max_by(key, F.struct("l_shipdate", -key)).alias("profile"))


@query("W5_rank_assignment", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders", ints=("rank",))
def w5(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))


@query("W6_revision_numbers", "SELECT o_custkey, max(o_orderkey % 7) + 1 AS next_revision FROM orders GROUP BY 1")
def w6(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.max(F.col("o_orderkey") % 7) + 1).alias("next_revision"))


@query("W7_closed_after_solution", "SELECT o_orderkey, o_orderdate + INTERVAL 60 DAY > first_ship AS closed_after FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON l_orderkey = o_orderkey")
def w7(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_ship"))
    return table(spark, sf_dir, "orders").join(first, "o_orderkey").select("o_orderkey", (F.expr("o_orderdate + interval 60 days") > F.col("first_ship")).alias("closed_after"))


@query("W8_representative", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars % 10 DESC, length(text), doc_id) AS rn FROM documents) WHERE rn = 1")
def w8(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("chars", F.length("text"))
    return d.groupBy("source").agg(F.min_by("doc_id", F.struct(-(F.col("n_chars") % 10), "chars", "doc_id")).alias("doc_id"))


@query("W9_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events")
def w9(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("h", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return tables.carry_forward(e, ["user_id"], "event_id", "h", "heading").select("event_id", "heading")


@query("O3_context_priority", "SELECT conv_id, turn, priority FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority DESC, turn) AS rn FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 1000000 ELSE 0 END + CASE WHEN role = 'assistant' THEN 100000 ELSE 0 END + CASE WHEN role = 'system' THEN 50000 ELSE 0 END + CASE WHEN role = 'user' THEN 25000 ELSE 0 END + length(text) AS priority FROM conversations)) WHERE rn <= 3", ints=("priority",))
def o3(spark, sf_dir):
    pts = (
        F.when(F.col("turn") == 0, 1_000_000).otherwise(0)
        + F.when(F.col("role") == "assistant", 100_000).when(F.col("role") == "system", 50_000).when(F.col("role") == "user", 25_000).otherwise(0)
        + F.length("text")
    )
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", pts.alias("priority"))
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("priority"), "turn"))
    return c.withColumn("rn", rn).where("rn <= 3").drop("rn")


@query("O5_chronological", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn <> 0, length(text), turn) AS place FROM conversations", ints=("place",))
def o5(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn") != 0, F.length("text"), "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("place"))


@query("O6_recent_activity", "SELECT * FROM (SELECT 'event' AS kind, event_id AS id, ts AS \"at\" FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders UNION ALL SELECT 'ship', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem) ORDER BY \"at\" DESC, kind, id DESC LIMIT 12")
def o6(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    s = table(spark, sf_dir, "lineitem").select(F.lit("ship").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("at"))
    return e.unionByName(o).unionByName(s).orderBy(F.desc("at"), "kind", F.desc("id")).limit(12)


@query("O7_alternatives", "SELECT o_custkey, place, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place >= 1 AND place < 6", ints=("place",))
def o7(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select("o_custkey", place.alias("place"), "o_orderkey").where("place >= 1 AND place < 6")


@query("O8_review_queue", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_discount DESC, l_shipdate DESC, l_orderkey, l_linenumber LIMIT 100")
def o8(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return q.orderBy(F.desc_nulls_last("l_discount"), F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber")


@query("O9_fifo_queue", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 50")
def o9(spark, sf_dir):
    return access.fifo(table(spark, sf_dir, "events"), "ts", "event_id", 50, F.col("event_type") == "error").select("event_id")


# sets and sinks --------------------------------------------------------------------------------------------------


@query("U1_evidence_union", "SELECT l_orderkey, l_partkey, arg_max(l_linenumber, l_linenumber) AS kept FROM lineitem GROUP BY 1, 2")
def u1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    both = li.where("l_returnflag = 'R'").unionByName(li.where("l_returnflag <> 'R'"))
    return both.groupBy("l_orderkey", "l_partkey").agg(F.max_by("l_linenumber", "l_linenumber").alias("kept"))


@query("U4_versioned_union", "SELECT event_id AS id, user_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, NULL FROM events WHERE event_type = 'view'")
def u4(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v2 = e.where("event_type = 'click'").select(F.col("event_id").alias("id"), "user_id", "value")
    return v2.unionByName(e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id"), allowMissingColumns=True)


@query("U5_schedule_reconciliation", "SELECT DISTINCT p_partkey, 'upsert' AS action FROM part WHERE p_size > 25 UNION ALL SELECT DISTINCT l_partkey, 'remove' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def u5(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey")
    return tables.set_difference(wanted, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("S12_snapshots", "SELECT doc_id, sha256(text) AS digest, sha256('[1,\"' || source || '\",\"' || lang || '\",\"' || sha256(text) || '\"]') AS dedup_key, CASE WHEN source IN ('src0','src1') THEN 'first_party_official' ELSE 'community' END AS authority FROM documents")
def s12(spark, sf_dir):
    from tarnwork.functions.text import versioned_key

    d = table(spark, sf_dir, "documents").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    authority = F.when(F.col("source").isin("src0", "src1"), "first_party_official").otherwise("community")
    return d.select("doc_id", "digest", versioned_key(F.col("source"), F.col("lang"), F.col("digest")).alias("dedup_key"), authority.alias("authority"))


@query("S13_insert_absent", "SELECT digest, min(doc_id) AS doc_id FROM (SELECT md5(text) AS digest, doc_id FROM documents WHERE doc_id % 2 = 1) WHERE digest NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def s13(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id")
    return tables.insert_absent(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), ["digest"])


@query("S14_state_upsert", "SELECT coalesce(o.u, n.u) AS user_id, coalesce(n.last, o.last) AS last, CASE WHEN o.u IS NULL THEN n.first ELSE o.first END AS first FROM (SELECT user_id AS u, max(ts) AS last, min(event_id) AS first FROM events WHERE ts < TIMESTAMP '2024-01-05' AND user_id % 3 <> 0 GROUP BY 1) o FULL JOIN (SELECT user_id AS u, max(ts) AS last, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND user_id % 2 = 0 GROUP BY 1) n ON o.u = n.u")
def s14(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = lambda df: df.groupBy("user_id").agg(F.max("ts").alias("last"), F.min("event_id").alias("first"))
    day = F.expr("timestamp'2024-01-05'")
    return tables.upsert(g(e.where((F.col("ts") < day) & (F.col("user_id") % 3 != 0))), g(e.where((F.col("ts") >= day) & (F.col("user_id") % 2 == 0))), ["user_id"], ("first",))


@query("S15_guarded_transition", f"SELECT id, CASE WHEN status IN ('draft', 'review') THEN 'active' ELSE status END AS status FROM {_REC}")
def s15(spark, sf_dir):
    return records(spark, sf_dir).select("id", tables.transition(F.col("status"), ["draft", "review"], F.lit("active")).alias("status"))


@query("S16_expired", "SELECT event_id, ts FROM events WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 200")
def s16(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.expr("ts + interval 1 day <= timestamp'2024-01-15'"))
    return e.orderBy("ts", "event_id").limit(200).select("event_id", "ts")


@query("S17_monotonic_pointer", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS pointer FROM events GROUP BY 1")
def s17(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("pointer"))

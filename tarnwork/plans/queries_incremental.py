"""Incremental reads, limits, folds and job states over events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwork.operators import jobs, tables
from tarnwork.plans.catalog import query, table
from tarnwork.plans.shared import shared_dir
from tarnwork.streaming import incremental


@query("T1_cursor_overlap", "SELECT count(*) AS n, max(ts) AS cursor FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR")
def t1(spark, sf_dir):
    return incremental.since_cursor(table(spark, sf_dir, "events"), "ts", "2024-01-20").agg(F.count("*").alias("n"), F.max("ts").alias("cursor"))


@query("T2_late_rows_without_change", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AND NOT (ts < TIMESTAMP '2024-01-20' AND event_type <> 'error')")
def t2(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.md5(F.col("props").cast("binary")).alias("digest"))
    seen = e.where("ts < timestamp'2024-01-20' AND event_type <> 'error'")
    return incremental.fresh_revisions(incremental.since_cursor(e, "ts", "2024-01-20"), seen, "event_id", "digest").select("event_id")


@query("T3_T4_pending_dispatch", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)")
def t4(spark, sf_dir):
    sent = table(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.missing(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey"), sent, ["o_orderkey"])


@query("T5_retry_or_quarantine", "SELECT event_id, CASE WHEN event_id % 7 >= CASE event_type WHEN 'error' THEN 4 WHEN 'click' THEN 3 ELSE 5 END THEN 'quarantined' ELSE 'retrying' END AS state FROM events")
def t5(spark, sf_dir):
    job = F.when(F.col("event_type") == "error", "source.extract").when(F.col("event_type") == "click", "development.fail").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", jobs.after_failure(job, F.col("event_id") % 7).alias("state"))


@query(
    "T6_rate_gate",
    """WITH RECURSIVE r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT event_id, user_id, rn, ts AS start, 1 AS n FROM r WHERE rn = 1
     UNION ALL SELECT r.event_id, r.user_id, r.rn, CASE WHEN r.ts >= f.start + INTERVAL 1 DAY THEN r.ts ELSE f.start END, CASE WHEN r.ts >= f.start + INTERVAL 1 DAY THEN 1 ELSE f.n + 1 END FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
    SELECT event_id, n <= 3 AS allowed FROM f""",
)
def t6(spark, sf_dir):
    return incremental.rate_gate(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 86_400, 3, "event_id").select("event_id", "allowed")


@query("T7_trailing_and_daily_caps", "SELECT a.event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 12 HOUR) AS trailing, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS today FROM events a", ints=("today",))
def t7(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    got = incremental.trailing_count(e, ["user_id"], "ts", 43_200, "trailing")
    return incremental.calendar_day_count(got, ["user_id"], "ts", "event_id", "today").select("event_id", "trailing", "today")


@query("T9_heartbeats", "SELECT user_id, max(ts) >= TIMESTAMP '2024-01-29 23:55:00' - INTERVAL 5 MINUTE AS alive FROM events GROUP BY 1")
def t9(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return g.select("user_id", (F.col("seen") >= F.expr("timestamp'2024-01-29 23:55:00' - interval 5 minutes")).alias("alive"))


@query(
    "O4_budgeted_prefix",
    """WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    f AS (SELECT conv_id, turn, chars, rn, chars <= 1500 AS kept, CASE WHEN chars <= 1500 THEN 1500 - chars ELSE 1500 END AS room FROM r WHERE rn = 1
     UNION ALL SELECT r.conv_id, r.turn, r.chars, r.rn, r.chars <= f.room, CASE WHEN r.chars <= f.room THEN f.room - r.chars ELSE f.room END FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)
    SELECT conv_id, turn, chars, kept FROM f""",
    ints=("chars",),
)
def o4(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return incremental.greedy_prefix(c, "conv_id", "turn", "chars", 1_500)


@query("T_stream_daily_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t_stream(spark, sf_dir):
    path, tag = f"{sf_dir}/events.parquet", uuid.uuid4().hex
    schema = spark.read.parquet(path).schema
    # a stream over one file needs a pattern, else Spark takes the path for a folder
    out = f"{shared_dir(spark)}/counts-{tag}"
    incremental.stream_counts(spark, path[:-1] + "[t]", schema, "ts", "event_type", f"{shared_dir(spark)}/stream-{tag}", out).awaitTermination()
    return incremental.latest_counts(spark, out, "event_type").select(F.col("window.start").alias("day"), "event_type", F.col("count").alias("n"))


@query("T1_T2_stream_rereads", "SELECT event_id, md5(props) AS digest, count(*) OVER (PARTITION BY event_id) AS times FROM events")
def t2_stream(spark, sf_dir):
    """Every event, read twice: a second reader begins 24 hours before its cursor and meets what the first one read."""
    path, tag = f"{sf_dir}/events.parquet", uuid.uuid4().hex
    read = lambda: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.md5(F.col("props").cast("binary")).alias("digest"))
    rows = read().union(incremental.since_cursor(read(), "ts", "2024-01-20"))
    out = f"{shared_dir(spark)}/revisions-{tag}"
    incremental.stream_revisions(rows, "ts", ["event_id", "digest"], out, f"{shared_dir(spark)}/stream-{tag}").awaitTermination()
    times = F.count("*").over(Window.partitionBy("event_id"))
    return spark.read.parquet(out).select("event_id", "digest", times.alias("times"))

"""Outcome analytics over events (a month) and orders (years)."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from tarnwork.functions import scores
from tarnwork.operators import outcomes, rescoring
from tarnwork.plans.catalog import query, table
from tarnwork.plans.shared import shared_dir

_EVENT = "CASE event_type WHEN 'purchase' THEN 'solved' WHEN 'click' THEN 'partially_helped' WHEN 'error' THEN 'attempted_failed' WHEN 'signup' THEN 'incompatible_environment' ELSE 'not_used' END"
_ORDER = "CASE o_orderstatus WHEN 'F' THEN 'solved' WHEN 'P' THEN 'partially_helped' ELSE 'attempted_failed' END"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_EV = f"(SELECT event_id AS outcome_id, {_K} % 20 AS path, user_id, 'v' || ({_K} % 3) AS bucket, {_EVENT} AS outcome, ts AS at_, ts AS t FROM events)"
_OR = f"(SELECT o_orderkey AS outcome_id, o_orderkey % 20 AS path, o_custkey AS user_id, 'v' || (o_orderkey % 7) AS bucket, {_ORDER} AS outcome, o_orderdate AS t FROM orders)"
EVENTS_AS_OF, ORDERS_AS_OF = "2024-03-31", "2001-08-01"


def from_events(spark, sf_dir):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("outcome_id"), (k % 20).alias("path"), "user_id", F.concat(F.lit("v"), k % 3).alias("bucket"), F.expr(_EVENT).alias("outcome"), F.col("ts").alias("at"))


def from_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("outcome_id"), (F.col("o_orderkey") % 20).alias("path"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("v"), F.col("o_orderkey") % 7).alias("bucket"), F.expr(_ORDER).alias("outcome"), F.col("o_orderdate").alias("at"))


def as_of(day: str):
    return F.to_timestamp(F.lit(f"{day} 00:00:00"))


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_WEIGHTS = f"SELECT *, (epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(t)) / 86400000000.0 AS age FROM {_OR}"
_CONF = f"""WITH a AS ({_WEIGHTS}), w AS (SELECT *, CASE WHEN greatest(age, 0) <= 30 THEN 1.0::DOUBLE ELSE pow(0.5, (age - 30) / 180) END AS w, outcome <> 'attempted_failed' AS hit, outcome = 'solved' AS full_hit, age <= 90 AS rec, age > 90 AND age <= 365 AS base FROM a),
g AS (SELECT path, sum(w) AS t, sum(w*w) AS s, sum(CASE WHEN hit THEN w ELSE 0 END) AS h, sum(CASE WHEN full_hit THEN w ELSE 0 END) AS f,
  sum(CASE WHEN rec THEN w ELSE 0 END) AS rt, sum(CASE WHEN rec THEN w*w ELSE 0 END) AS rs, sum(CASE WHEN rec AND hit THEN w ELSE 0 END) AS rh,
  sum(CASE WHEN base THEN 1.0::DOUBLE ELSE 0 END) AS bn, sum(CASE WHEN base AND hit THEN 1.0::DOUBLE ELSE 0 END) AS bh,
  count(*) FILTER (WHERE rec AND NOT hit) AS recent_failures, count(DISTINCT CASE WHEN rec AND NOT hit THEN user_id END) AS failing_users FROM w GROUP BY path),
n AS (SELECT *, t*t/s AS ess, h/t AS p, f/t AS pf, CASE WHEN rs = 0 THEN 0 ELSE rt*rt/rs END AS rn, CASE WHEN rt = 0 THEN 0 ELSE rh/rt END AS rp, CASE WHEN bn = 0 THEN 0 ELSE bh/bn END AS bp FROM g),
b AS (SELECT *, greatest(0, (p + 3.8416/(2*ess) - 1.96*sqrt(p*(1-p)/ess + 3.8416/(4*ess*ess)))/(1+3.8416/ess)) AS any_low,
  least(1, (p + 3.8416/(2*ess) + 1.96*sqrt(p*(1-p)/ess + 3.8416/(4*ess*ess)))/(1+3.8416/ess)) AS any_high,
  greatest(0, (pf + 3.8416/(2*ess) - 1.96*sqrt(pf*(1-pf)/ess + 3.8416/(4*ess*ess)))/(1+3.8416/ess)) AS full_low,
  CASE WHEN rn = 0 THEN 0 ELSE greatest(0, (rp + 3.8416/(2*rn) - 1.96*sqrt(rp*(1-rp)/rn + 3.8416/(4*rn*rn)))/(1+3.8416/rn)) END AS rl,
  CASE WHEN bn = 0 THEN 0 ELSE greatest(0, (bp + 3.8416/(2*bn) - 1.96*sqrt(bp*(1-bp)/bn + 3.8416/(4*bn*bn)))/(1+3.8416/bn)) END AS bl FROM n),
c AS (SELECT *, greatest(0, bl - rl) AS lb_drop, CAST(floor(100*(0.65*any_low + 0.35*full_low) + 0.5) AS INT) AS score FROM b)"""


@query("A5_effective_sample_size", f"{_CONF} SELECT path, round(ess, 6) AS ess FROM c")
def a5(spark, sf_dir):
    return _rounded(outcomes.confidence(from_orders(spark, sf_dir), as_of(ORDERS_AS_OF)).select("path", "ess"))


@query("A6_wilson_interval", f"{_CONF} SELECT path, round(any_low, 6) AS any_low, round(any_high, 6) AS any_high, round(full_low, 6) AS full_low FROM c")
def a6(spark, sf_dir):
    return _rounded(outcomes.confidence(from_orders(spark, sf_dir), as_of(ORDERS_AS_OF)).select("path", "any_low", "any_high", "full_low"))


@query("A7_outcome_confidence", f"{_CONF} SELECT path, score, CASE WHEN score < 25 THEN 'very_low' WHEN score < 50 THEN 'low' WHEN score < 70 THEN 'moderate' WHEN score < 85 THEN 'high' ELSE 'very_high' END AS grade FROM c")
def a7(spark, sf_dir):
    return outcomes.confidence(from_orders(spark, sf_dir), as_of(ORDERS_AS_OF)).select("path", "score", "grade")


@query(
    "A8_decline",
    f"{_CONF} SELECT path, round(rn, 6) AS recent_n, bn AS base_n, round(lb_drop, 6) AS \"drop\", recent_failures, failing_users, CASE WHEN rn >= 5 AND bn >= 10 THEN CASE WHEN lb_drop >= 0.2 AND recent_failures >= 3 AND failing_users >= 3 THEN 'declining' ELSE 'stable' END ELSE 'insufficient' END AS trend FROM c",
)
def a8(spark, sf_dir):
    got = outcomes.confidence(from_orders(spark, sf_dir), as_of(ORDERS_AS_OF))
    return _rounded(got.select("path", "recent_n", "base_n", "drop", "recent_failures", "failing_users", "trend"))


@query("A9_safety_corroboration", f"SELECT path, count(DISTINCT user_id) AS unsafe_users, count(DISTINCT user_id) >= 2 AS corroborated FROM {_EV} WHERE outcome = 'attempted_failed' AND t >= TIMESTAMP '2024-01-01' GROUP BY 1")
def a9(spark, sf_dir):
    rows = from_events(spark, sf_dir).withColumn("outcome", F.when(F.col("outcome") == "attempted_failed", "misleading_or_unsafe").otherwise(F.col("outcome")))
    got = outcomes.confidence(rows, as_of(EVENTS_AS_OF)).where("unsafe_users > 0")
    return got.select("path", "unsafe_users", F.array_contains("penalties", "corroborated_safety").alias("corroborated"))


@query(
    "A4_outcome_counts",
    f"SELECT path, count(*) AS total, count(*) FILTER (WHERE outcome <> 'not_used') AS effective, count(*) FILTER (WHERE outcome = 'not_used') AS excluded, count(DISTINCT CASE WHEN outcome <> 'not_used' THEN user_id END) AS users, count(*) FILTER (WHERE outcome = 'solved') AS solved, count(*) FILTER (WHERE outcome = 'partially_helped') AS partially_helped, count(*) FILTER (WHERE outcome = 'attempted_failed') AS attempted_failed, count(*) FILTER (WHERE outcome = 'incompatible_environment') AS incompatible, count(*) FILTER (WHERE outcome = 'not_used') AS not_used, count(*) FILTER (WHERE outcome IN ('solved', 'partially_helped') AND t >= TIMESTAMP '2024-01-01') AS recent_successes FROM {_EV} GROUP BY 1",
)
def a4(spark, sf_dir):
    rows = from_events(spark, sf_dir).withColumn("influence", F.when(F.col("outcome") == "not_used", "not_evidence").otherwise("eligible"))
    return outcomes.counts(rows, as_of(EVENTS_AS_OF))


@query("A10_version_distribution", f"SELECT path, bucket, count(*) AS n, count(*) FILTER (WHERE outcome = 'solved') AS solved, count(*) FILTER (WHERE outcome = 'attempted_failed') AS failed, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, bucket) AS place FROM {_EV} WHERE outcome <> 'not_used' GROUP BY 1, 2", ints=("place",))
def a10(spark, sf_dir):
    return outcomes.version_distribution(from_events(spark, sf_dir).where("outcome <> 'not_used'"))


@query("A11_latest_outcomes", f"SELECT path, max(CASE WHEN outcome IN ('solved', 'partially_helped') THEN t END) AS last_successful, max(CASE WHEN outcome = 'attempted_failed' THEN t END) AS last_failed FROM {_EV} GROUP BY 1")
def a11(spark, sf_dir):
    return outcomes.latest_dates(from_events(spark, sf_dir))


_FOLD = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY path, user_id, bucket ORDER BY t, outcome_id) AS rn FROM {_EV} WHERE outcome <> 'not_used'),
f AS (SELECT path, user_id, bucket, rn, outcome_id, t AS last_t, true AS ok FROM r WHERE rn = 1
  UNION ALL SELECT r.path, r.user_id, r.bucket, r.rn, r.outcome_id, CASE WHEN f.last_t >= r.t - INTERVAL 5 DAY THEN f.last_t ELSE r.t END, NOT f.last_t >= r.t - INTERVAL 5 DAY FROM f JOIN r ON r.path = f.path AND r.user_id = f.user_id AND r.bucket = f.bucket AND r.rn = f.rn + 1)"""


@query("W4_influence_window", f"{_FOLD} SELECT outcome_id, CASE WHEN ok THEN 'eligible' ELSE 'duplicate_window' END AS influence FROM f UNION ALL SELECT outcome_id, 'not_evidence' FROM {_EV} WHERE outcome = 'not_used'")
def w4(spark, sf_dir):
    return outcomes.influence(from_events(spark, sf_dir), days=5).select("outcome_id", "influence")


@query("J10_originators", f"SELECT outcome_id, (path, user_id) IN (SELECT (path, user_id) FROM {_EV} WHERE outcome = 'incompatible_environment') AS originator FROM {_EV}")
def j10(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    own = rows.where("outcome = 'incompatible_environment'").select("path", "user_id").distinct().withColumn("own", F.lit(True))
    return rows.join(own, ["path", "user_id"], "left").select("outcome_id", F.coalesce("own", F.lit(False)).alias("originator"))


@query(
    "R8_influence_precedence",
    f"SELECT influence, count(*) AS n FROM (SELECT CASE WHEN outcome = 'not_used' THEN 'not_evidence' WHEN user_id % 5 = 0 THEN 'originator_non_independent' WHEN row_number() OVER (PARTITION BY path, user_id, bucket, outcome = 'not_used' ORDER BY t, outcome_id) > 1 THEN 'duplicate_window' ELSE 'eligible' END AS influence FROM {_EV}) GROUP BY 1",
)
def r8(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    own = rows.where("user_id % 5 = 0").select("path", "user_id")
    return outcomes.influence(rows, own, days=3650).groupBy("influence").agg(F.count("*").alias("n"))


@query("X25_evidence_freshness", f"SELECT o_orderkey, CASE WHEN age <= g THEN 100 ELSE greatest(0, CAST(floor(100 * pow(2.0, -(age - g) / h) + 0.5) AS INT)) END AS score, CASE WHEN age <= g THEN 'current' WHEN greatest(0, CAST(floor(100 * pow(2.0, -(age - g) / h) + 0.5) AS INT)) >= 50 THEN 'aging' ELSE 'stale' END AS status FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}') AS age, CASE WHEN o_orderstatus = 'F' THEN 90 ELSE 180 END AS g, CASE WHEN o_orderstatus = 'F' THEN 180.0::DOUBLE ELSE 365.0::DOUBLE END AS h FROM orders)")
def x25(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    age = F.floor(scores.age_days(F.col("o_orderdate"), as_of(ORDERS_AS_OF))).cast("int")
    score, status = scores.freshness(age, F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", score.alias("score"), status.alias("status"))


@query("X26_recency_weight", f"SELECT outcome_id, round(CASE WHEN age <= 30 THEN 1 ELSE pow(0.5, (age - 30) / 180) END, 9) AS weight FROM ({_WEIGHTS})")
def x26(spark, sf_dir):
    return from_orders(spark, sf_dir).select("outcome_id", F.round(scores.recency_weight(F.col("at"), as_of(ORDERS_AS_OF)), 9).alias("weight"))


@query("X27_search_freshness", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN o_orderkey % 9 = 0 AND o_orderdate + INTERVAL 300 DAY < TIMESTAMP '{ORDERS_AS_OF}' THEN 'stale' WHEN TIMESTAMP '{ORDERS_AS_OF}' - o_orderdate > INTERVAL 180 DAY THEN 'aging' ELSE 'current' END AS label FROM orders")
def x27(spark, sf_dir):
    verified = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    stale = F.when(F.col("o_orderkey") % 9 == 0, F.expr("o_orderdate + interval 300 days"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scores.search_freshness(verified, stale, as_of(ORDERS_AS_OF)).alias("label"))


@query("X28_popularity", "SELECT user_id, least(6, CAST(floor(log2(count(*) + 1) * 2) AS INT)) AS points, -least(6, CAST(floor(log2(count(*) FILTER (WHERE event_type = 'error') + 1) * 2) AS INT)) AS against FROM events GROUP BY 1")
def x28(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return g.select("user_id", scores.popularity(F.col("n")).alias("points"), (-scores.popularity(F.col("bad"))).alias("against"))


@query("R20_safety_queue", f"SELECT DISTINCT path FROM {_EV} WHERE outcome = 'attempted_failed' AND bucket = 'v0' AND path NOT IN (SELECT path FROM {_EV} WHERE outcome = 'incompatible_environment' AND bucket = 'v1' AND user_id < 3)")
def r20(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    opened = rows.where("outcome = 'incompatible_environment' and bucket = 'v1' and user_id < 3").select("path")
    return rows.where("outcome = 'attempted_failed' and bucket = 'v0'").select("path").distinct().join(opened, "path", "left_anti")


RESCORED = ("1998-01-01", "2000-06-01", "2001-08-02")
_GRADED = "round(ess, 6) AS ess, round(any_low, 6) AS any_low, round(any_high, 6) AS any_high, score, round(rn, 6) AS recent_n, bn AS base_n, round(lb_drop, 6) AS \"drop\", recent_failures, failing_users, CASE WHEN rn >= 5 AND bn >= 10 THEN CASE WHEN lb_drop >= 0.2 AND recent_failures >= 3 AND failing_users >= 3 THEN 'declining' ELSE 'stable' END ELSE 'insufficient' END AS trend"


def _from_scratch(day: str) -> str:
    sql = _CONF.replace(_OR, f"(SELECT * FROM {_OR} WHERE t < TIMESTAMP '{day}')").replace(ORDERS_AS_OF, day)
    return f"SELECT * FROM ({sql} SELECT '{day}' AS as_of, path, {_GRADED} FROM c)"


@query("T8_rescoring", " UNION ALL ".join(_from_scratch(d) for d in RESCORED))
def t8(spark, sf_dir):
    """Confidence on three dates; each reads the stored state of the date before and the reports since then."""
    rows, where = from_orders(spark, sf_dir), f"{shared_dir(spark)}/rescoring-{uuid.uuid4().hex}"
    held, before, found = None, None, []
    for day in RESCORED:
        date = datetime.date.fromisoformat(day)
        fresh = rows.where(F.col("at") < as_of(day))
        new = rescoring.state(fresh if before is None else fresh.where(F.col("at") >= as_of(before)), date)
        held = rescoring.saved(new if held is None else rescoring.merged(held, new), f"{where}/{day}")
        before = day
        found.append(rescoring.rescored(held).withColumn("as_of", F.lit(day)))
    got = found[0].unionByName(found[1]).unionByName(found[2])
    return _rounded(got.select("as_of", "path", "ess", "any_low", "any_high", "score", "recent_n", "base_n", "drop", "recent_failures", "failing_users", "trend"))

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import outcomes, rescoring

REPORT = "path string, user_id long, outcome string, at timestamp"
OUTCOMES = (*outcomes.ATTEMPTED, "misleading_or_unsafe", "incompatible_environment", "not_used", None)
DAYS = [datetime.date(2024, 1, 1), datetime.date(2024, 3, 10), datetime.date(2025, 7, 1)]


def moment(day):
    return datetime.datetime.combine(day, datetime.time())


def reports(rng, n, until):
    out = []
    for _ in range(n):
        at = moment(until) - datetime.timedelta(microseconds=rng.randrange(1, 900 * 86_400_000_000))
        if rng.random() < 0.2:  # on the borders of the windows, to the microsecond
            at = moment(until) - datetime.timedelta(days=rng.choice([30, 90, 365]), microseconds=rng.choice([-1, 0, 1]))
        out.append((rng.choice(["a", "a", "b", "c", None]), rng.choice([*range(9), None]), rng.choice(OUTCOMES), None if rng.random() < 0.03 else at))
    return out


def from_scratch(spark, rows, day):
    df = spark.createDataFrame(rows, REPORT)
    return outcomes.confidence(df, F.to_timestamp(F.lit(f"{day} 00:00:00")))


def same(got, want):
    key = lambda r: repr(r["path"])
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [r["path"] for r in got] == [r["path"] for r in want]
    for g, w in zip(got, want, strict=True):
        for c, v in w.asDict().items():
            if isinstance(v, float):
                assert math.isclose(g[c], v, rel_tol=1e-9, abs_tol=1e-9), (w["path"], c, g[c], v)
            else:
                assert g[c] == v, (w["path"], c)


@pytest.mark.parametrize("seed", range(2))
def test_scaled_state_is_confidence_from_scratch_at_three_dates(spark, tmp_path, seed):
    rng = random.Random(seed)
    seen, held = [], None
    for i, day in enumerate(DAYS):
        new = reports(rng, 150, day)  # many of them late: older than the state's day, and than its windows
        seen += new
        fresh = rescoring.state(spark.createDataFrame(new, REPORT), day)
        held = rescoring.saved(fresh if held is None else rescoring.merged(held, fresh), f"{tmp_path}/{i}")
        same(rescoring.rescored(held), from_scratch(spark, seen, day))
        later = day + datetime.timedelta(days=47)
        same(rescoring.rescored(held, later), from_scratch(spark, seen, later))


def test_order_of_merging_and_what_is_kept(spark):
    rng = random.Random(7)
    parts = [reports(rng, 80, d) for d in DAYS]
    a, b, c = (rescoring.state(spark.createDataFrame(p, REPORT), d) for p, d in zip(parts, DAYS, strict=True))
    one, other = rescoring.merged(rescoring.merged(a, b), c), rescoring.merged(c, rescoring.merged(b, a))
    same(rescoring.rescored(one), rescoring.rescored(other))
    first = (DAYS[-1] - datetime.date(1970, 1, 1)).days - outcomes.BASELINE_DAYS
    assert one.days.where(F.col("day") < first).count() == 0
    assert one.tail.count() == len({p for rows in parts for p, _, _, _ in rows})
    old = moment(DAYS[-1]) - datetime.timedelta(days=90)
    assert one.users.where(F.greatest("failed_at", "unsafe_at") < F.lit(old)).count() == 0


def test_empty_unobserved_and_going_back(spark):
    none = rescoring.state(spark.createDataFrame([], REPORT), DAYS[0])
    assert rescoring.rescored(none).count() == 0
    idle = [("a", 1, "not_used", moment(DAYS[0])), ("b", 1, "not_used", datetime.datetime(1960, 1, 1, 5))]
    held = rescoring.merged(none, rescoring.state(spark.createDataFrame(idle, REPORT), DAYS[1]))
    same(rescoring.rescored(held), from_scratch(spark, idle, DAYS[1]))
    assert {r["grade"] for r in rescoring.rescored(held).collect()} == {"unobserved"}
    with pytest.raises(ValueError):
        rescoring.rescored(held, DAYS[0])
    with pytest.raises(ValueError):
        rescoring.merged(none, held, DAYS[0])

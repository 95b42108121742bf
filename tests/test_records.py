import random

import pytest

from tarnwork.operators import records

MEMBER = "candidate_id long, record_id long, disposition string, solution_key string, since long, until long"
EVENT = "operation_id string, sequence long, kind string, candidate_id long, record_id long, solution_key string"


def sequential(members, events, done=()):
    """Applies events one by one. Support by candidate, conflicts, and the outcome of each event."""
    support = {c: (r, k) for c, r, d, k, _, until in members if d == "supporting" and until is None}
    against = {(c, r): k for c, r, d, k, _, until in members if d == "conflicting" and until is None}
    seen, out = set(done), []
    for op, seq, kind, c, r, k in sorted(events, key=lambda e: e[1]):
        before = support.get(c, (None,))[0]
        if op in seen:
            out.append((op, seq, "repeated"))
            continue
        seen.add(op)
        ok = kind in records.KINDS and (r is not None or kind == "split")
        ok = ok and (before is None if kind == "attach" else True if kind == "conflict" else before is not None)
        state = "applied" if ok else "rejected"
        if ok and kind == "conflict":
            state = "unchanged" if (c, r) in against else state
            against.setdefault((c, r), k)
        elif ok and kind == "split":
            del support[c]
        elif ok:
            support[c] = (r, k)
        out.append((op, seq, state))
    return support, against, sorted(out)


def random_log(rng, n, first):
    kinds = ["attach", "attach", "split", "reassign", "conflict", "unknown"]
    out = []
    for i in range(n):
        op = f"op{first + i}" if rng.random() < 0.9 else f"op{first + rng.randrange(i + 1)}"
        kind = rng.choice(kinds)
        out.append((op, first + i, kind, 0 if rng.random() < 0.3 else rng.randrange(25), None if kind == "split" or rng.random() < 0.05 else rng.randrange(8), f"k{rng.randrange(3)}"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_one_by_one_and_to_a_rebuild(spark, seed):
    rng = random.Random(seed)
    members = [(c, rng.randrange(8), "supporting", "k0", None, None) for c in range(0, 25, 2)] + [(3, 1, "conflicting", "k1", None, None), (1, 5, "supporting", "k0", None, 0)]
    table = spark.createDataFrame(members, MEMBER)
    log, applied, known = [], None, spark.createDataFrame([(i,) for i in range(8)], "record_id long")
    first_state = {r["record_id"]: r.asDict() for r in records.rebuilt(known, table).collect()}
    for part in range(3):
        new = random_log(rng, 60, 1 + 60 * part) + log[-5:]  # the end of the log before is sent again
        got = records.changed(table, spark.createDataFrame(new, EVENT), applied)
        support, against, outcomes = sequential(members, log + new[:60])
        told = sorted((r["operation_id"], r["sequence"], r["outcome"]) for r in got.events.collect() if r["sequence"] > 60 * part)
        assert told == [o for o in outcomes if o[1] > 60 * part]
        assert all(r["outcome"] == "repeated" for r in got.events.collect() if r["sequence"] <= 60 * part)
        now = records.active(got.memberships).collect()
        assert {r["candidate_id"]: (r["record_id"], r["solution_key"]) for r in now if r["disposition"] == "supporting"} == support
        assert {(r["candidate_id"], r["record_id"]): r["solution_key"] for r in now if r["disposition"] == "conflicting"} == against
        first_state |= {r["record_id"]: r.asDict() for r in got.records.collect()}  # only these are written again
        assert first_state == {r["record_id"]: r.asDict() for r in records.rebuilt(known, got.memberships).collect()}
        log += new[:60]
        table = spark.createDataFrame(got.memberships.collect(), MEMBER)
        applied = spark.createDataFrame([(e[0],) for e in log], "operation_id string")
    for sequence in (0, 17, 100, 180):
        support, *_ = sequential(members, [e for e in log if e[1] <= sequence])
        assert {r["candidate_id"]: r["record_id"] for r in records.at(table, sequence).where("disposition = 'supporting'").collect()} == {c: r for c, (r, _) in support.items()}


def test_archive_and_edges(spark):
    table = spark.createDataFrame([(1, 10, "supporting", "a", None, None), (2, 20, "supporting", "b", None, None), (3, 10, "conflicting", None, None, None)], MEMBER)
    got = records.changed(table, spark.createDataFrame([("x", 1, "split", 1, None, None)], EVENT))
    assert [(r["record_id"], r["status"], r["supporting"], r["conflicting"]) for r in got.records.collect()] == [(10, "archived", 0, 1)]
    back = records.changed(got.memberships, spark.createDataFrame([("y", 2, "reassign", 2, 10, "a"), (None, 3, "attach", None, 10, "a"), ("z", 4, "attach", 9, None, "a")], EVENT))
    assert sorted((r["record_id"], r["status"]) for r in back.records.collect()) == [(10, "active"), (20, "archived")]
    assert {r["operation_id"]: r["outcome"] for r in back.events.collect()}["z"] == "rejected"
    none = records.changed(table, spark.createDataFrame([], EVENT))
    assert none.records.count() == 0 and none.memberships.count() == 3
    assert records.changed(table.limit(0), spark.createDataFrame([], EVENT)).memberships.count() == 0

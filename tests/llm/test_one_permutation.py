import hashlib
import random
import re

from tarnwork.llm.one_permutation import fingerprint_documents


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 9, 40, 200, 700]))) for _ in range(120)]
    texts += ["same text of seven words right here", "same text of seven words right here", None, "", "   ", "ü😀é one", "x" * 5000]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string").repartition(6)
    got = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, t, _) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r["fingerprint"]) == (256 if shingles(t) else 0)
        for est, true in ((r["near_edited"], jaccard(shingles(t), shingles(edited))), (r["near_next"], jaccard(shingles(t), shingles(n)))):
            assert 0 <= est <= 1
            errors.append(est - true)
            if true == 1:
                assert est == 1
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.02
    assert got[360]["fingerprint"] == got[363]["fingerprint"]


def test_very_long_text_and_hot_id(spark):
    rows = [(1, "long words " * 200_000), (2, "b")] + [(9, f"same id {i % 3}") for i in range(400)]
    got = fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {r["n_chars"] for r in got if r["doc_id"] == 1} == {2_200_000}


def test_edges(spark):
    schema = "doc_id long, text string"
    assert fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    (one,) = fingerprint_documents(spark.createDataFrame([(4, "a b c d")], schema)).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"a b a b c"[:4] + b"a b").hexdigest() and one["near_next"] == 1
    twice = fingerprint_documents(spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z"), (2, None)], schema)).collect()
    assert len(twice) == 4

import random

import pytest

from tarnwork.llm import jaccard_join
from tarnwork.llm import near_copies as nc


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def components(texts):
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    line = "this line stands in very many of the texts of this test"
    out = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(rng.choice((3, 8, 40, 120, 300)))]
        out.append(" ".join(body))
        for _ in range(3):  # from very like to not like enough
            near = list(body)
            for _ in range(rng.randint(1, max(1, len(body) // 25))):
                near[rng.randrange(len(near))] = "changed"
            out.append(" ".join(near))
        out.append(line + f" {k}")
    return out + [out[0], out[0].upper()] + [" ".join(rng.choice(words) for _ in range(9)) + " " + line for _ in range(40)]


def test_every_near_copy_goes(spark, texts):
    want = components(texts)
    assert len(set(want)) < len(set(texts)) - 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (nc.BUCKET_ROWS, 64, 1):
        got = dict(nc.near_copy_components(docs, rows).collect())
        assert [got[i] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in nc.keep_one_copy(docs).collect()) == sorted(set(want))


def test_stage_drops_what_four_bits_keep(spark, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components(texts)))


def test_simhash_groups_are_not_searched_again(spark, monkeypatch):
    rng = random.Random(5)
    body = ["w" + str(rng.randrange(900)) for _ in range(400)]
    texts = [" ".join(["few"] * (k % 3) + body + [f"end{k}"]) for k in range(24)]
    rows = [(i, t) for i, t in enumerate([*texts, "another text that no one has copied", " ".join(body[:350])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = []
    exact = jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda pairs, *rest: (counted.append(pairs.count()), exact(pairs, *rest))[1])
    kept = sorted(r["doc_id"] for r in nc.keep_one_copy(docs).collect())
    after_simhash = sum(counted)
    counted.clear()
    own = nc._golay_candidates
    monkeypatch.setattr(nc, "_golay_candidates", lambda leaders: own(leaders).limit(0))
    assert kept == sorted(r["doc_id"] for r in nc.keep_one_copy(docs).collect()) == [0, 24]
    assert after_simhash < sum(counted) / 2


def test_edges(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, None), (5, " "), (None, "only here"), (None, "only here"), (6, "one text"), (6, "another text")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, key int, set_id string")
    kept = nc.keep_one_copy(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, "only here"), (3, "a b"), (4, ""), (6, "another text"), (6, "one text")]
    assert nc.keep_one_copy(docs.limit(0)).count() == 0


def test_very_long_text_and_hot_set(spark):
    rng = random.Random(3)
    long = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(200_000)]
    near = list(long)
    for _ in range(3000):
        near[rng.randrange(len(near))] = "edit"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:100_000]))] + [(i, "one text that very many rows have") for i in range(10, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dict(nc.near_copy_components(docs).collect())
    assert got[1] == got[2] == 1 and got[3] == 3 and {got[i] for i in range(10, 2000)} == {10}

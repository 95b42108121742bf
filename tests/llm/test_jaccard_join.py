import random

import numpy as np
import pytest

from tarnwork.llm import jaccard_join as jj


def shingles(text):
    words = (text or "").lower().split()
    return ({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}) if words else set()


def expected(texts):
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
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
    return out + [out[0], out[0].upper(), "", None, " \t\n", "one"] + [" ".join(rng.choice(words) for _ in range(9)) + " " + line for _ in range(40)]


@pytest.mark.parametrize("bucket_rows, block, heavy", [(4, 1024, 500), (1, 7, 2), (64, 16, 3)])
def test_against_brute_force(spark, texts, bucket_rows, block, heavy, monkeypatch):
    monkeypatch.setattr(jj, "HEAVY", heavy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jj.similar_components(docs, bucket_rows, block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = expected(texts)
    assert len({c for *_, c in want}) < len(set(texts)) - 40
    assert sorted(map(tuple, got.collect())) == want


def test_a_large_group_of_near_copies(spark):
    """Every two of 400 differ, and the group is found through a few comparisons a member."""
    rng = random.Random(8)
    body = [str(rng.randrange(10**6)) for _ in range(200)]
    texts = []
    for i in range(400):
        near = list(body)
        near[rng.randrange(200)] = f"own{i}"
        texts.append(" ".join(near))
    docs = spark.createDataFrame([(i + 5, t) for i, t in enumerate(texts)] + [(1, "apart from the others it stands")], "doc_id long, text string")
    got = jj.similar_components(docs).collect()
    assert {r["component_id"] for r in got if r["doc_id"] > 1} == {5} and len(got) == 401


def test_edges(spark):
    rows = [(None, "a b"), (None, "A  b"), (3, "a b"), (3, "a b"), (4, None), (5, " "), (None, "only here"), (None, None), (6, "one text"), (6, "another text"), (2**62 + 5, "one text")]
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n int, digest string, component int")
    got = sorted((tuple(r) for r in jj.similar_components(docs).collect()), key=repr)
    want = [(None, 1, 3), (None, 1, 3), (3, 1, 3), (3, 1, 3), (4, 0, 4), (5, 0, 5), (None, 1, None), (None, 0, None), (6, 1, 6), (6, 1, 6), (2**62 + 5, 1, 6)]
    assert got == sorted(want, key=repr)
    assert jj.similar_components(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(3)
    long = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(200_000)]
    near = list(long)
    for _ in range(3000):
        near[rng.randrange(len(near))] = "edit"
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:100_000]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in jj.similar_components(docs).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[3]["component_id"] == 3
    assert got[1]["n_shingles"] == len(shingles(" ".join(long)))


def test_order_and_fragments():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, jj.CELLS)
    order = jj.Order(counts)
    s = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    ordered = order.sorted(s)
    often = counts[(ordered & np.uint64(jj.CELLS - 1)).astype(int)]
    assert (np.diff(often) >= 0).all() and sorted(ordered) == sorted(s)
    parts = order.fragments(ordered)
    assert np.array_equal(np.concatenate([p for _, p in parts]), ordered) and len(parts) == jj.FRAGMENTS
    assert max(len(p) for _, p in parts) < 5000
    some = ordered[::3]  # a shingle is in the same fragment of every set
    where = {h: i for i, p in parts for h in p}
    assert all(where[h] == i for i, p in order.fragments(some) for h in p)


def test_bitmaps_never_hide_a_similar_set():
    rng = np.random.default_rng(2)
    for n in (1, 3, 20, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for edits in range(0, n, max(1, n // 15)):
            b = np.unique(np.r_[a[edits:], rng.integers(0, 1 << 62, edits).astype(np.uint64)])
            x, y = (np.frombuffer(jj.bitmap(s), np.uint64) for s in (a, b))
            if jj.similar(len(np.intersect1d(a, b)), len(a), len(b)):
                assert jj.alike(x, y, len(a), len(b))
            elif n == 300 and edits > 90:
                assert not jj.alike(x, y, len(a), len(b))


def test_wide_bitmaps():
    """They hide no similar set, and tell large sets apart that the small bitmaps cannot."""
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    for n in (400, 513, 1000, 1100, 5000):
        a = np.unique(draw(n))
        for edits in range(0, n // 4, max(1, n // 40)):
            for b in (np.unique(np.r_[a[edits:], draw(edits)]), a[edits:]):
                if jj.similar(len(np.intersect1d(a, b)), len(a), len(b)):
                    assert jj.alike_wide(jj.wide_bitmap(a), jj.wide_bitmap(b), len(a), len(b))
    x, y = np.unique(draw(5000)), np.unique(draw(4500))
    assert jj.alike(*(np.frombuffer(jj.bitmap(s), np.uint64) for s in (x, y)), len(x), len(y))
    assert not jj.alike_wide(jj.wide_bitmap(x), jj.wide_bitmap(y), len(x), len(y))


def test_only_sets_in_a_likely_pair_are_moved(spark, monkeypatch):
    """Large texts, every two of which have one part in common."""
    counts, write = {}, jj.written
    monkeypatch.setattr(jj, "written", lambda df, tag: counts.setdefault(tag, []).append((out := write(df, tag)).count()) or out)
    rng = random.Random(9)
    part = {(i, j): " ".join(str(rng.randrange(10**6)) for _ in range(200)) for j in range(12) for i in range(j)}
    texts = [" ".join(part[min(i, j), max(i, j)] for j in range(12) if j != i) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["component_id"] for r in jj.similar_components(docs).collect()) == list(range(12))
    assert sum(counts["candidates"]) > 20 and sum(counts["needed"]) == 0

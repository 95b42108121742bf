import random

import numpy as np
import xxhash

from tarnwork.llm import simhash_golay as sg


def fingerprint(text):
    words = [w for w in bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: ids[top(k)] for k, i in enumerate(ids)}


def near(rng, x, most):
    for b in rng.sample(range(64), rng.randint(1, most)):
        x ^= 1 << b
    return x


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_against_brute_force():
    for t in (None, "", "  ", "One", "a b c", "A\tb\nc\x0bd e", "É b c d É b c d", "x y z w " * 50, "\xa0 nbsp stays in words"):
        assert sg.simhash64(t) == fingerprint(t)


def test_every_near_pair_shares_a_key():
    rng = random.Random(1)
    xs = [rng.getrandbits(64) for _ in range(3000)]
    ys = [near(rng, x, 4) for x in xs]
    a, b = (np.array([signed(v) for v in vs], np.int64) for vs in (xs, ys))
    row_a, key_a = sg.golay_keys(a)
    row_b, key_b = sg.golay_keys(b)
    shared = set(zip(row_a.tolist(), key_a.tolist())) & set(zip(row_b.tolist(), key_b.tolist()))
    assert {r for r, _ in shared} == set(range(len(xs)))
    one = sg._shared_key(a, b)
    assert all((i, int(k)) in shared for i, k in enumerate(one))


def test_links_by_keys_and_by_midpoints(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = list(dict.fromkeys(base + [near(rng, rng.choice(base[:3]), 5) for _ in range(150)] + [near(rng, b, 5) for b in base]))
    want = components(list(range(len(prints))), prints)
    fps = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    from tarnwork.plans.components import connected_components

    for rows in (4096, 3):
        groups = {r["node"]: r["component"] for r in connected_components(sg.near_links(fps, rows), "a", "b").collect()}
        got = {}
        for i, p in enumerate(prints):
            got.setdefault(groups.get(signed(p), signed(p)), set()).add(i)
        expected = {}
        for i, c in want.items():
            expected.setdefault(c, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_documents(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = []
    for _ in range(40):
        body = [rng.choice(words) for _ in range(200)]
        texts.append(" ".join(body))
        texts.append(" ".join(body[:100] + ["changed"] + body[101:]))
    texts += [None, "", " ", "same text here", "same text here", "SAME text here"] + ["copy of one"] * 30
    ids = list(range(5, 5 + len(texts)))
    want = components(ids, [fingerprint(t) for t in texts])
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["component_id"], r["fp"]) for r in sg.simhash_components(docs).collect()}
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(fp == signed(fingerprint(t)) for t, (_, fp) in zip(texts, (got[i] for i in ids)))
    assert sg.simhash_components(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert [r["component_id"] for r in sg.simhash_components(nulls).collect()] == [3] * 4


def test_very_long_text_and_hot_fingerprint(spark):
    rows = [(i, "copy of one") for i in range(3000)] + [(i, None) for i in range(3000, 4000)] + [(4000, "long words here and there " * 100_000), (4001, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in sg.simhash_components(docs).collect()}
    assert len(got) == len(rows) and {got[i] for i in range(3000)} == {0} and {got[i] for i in range(3000, 4000)} == {3000}
    assert got[4000] == 4000 and got[4001] == 4001

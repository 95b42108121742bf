import hashlib
import random
import zlib

import numpy as np
import pytest

from tarnwork.llm import merkle_manifest as mm

duckdb = pytest.importorskip("duckdb")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    i, text, lang, source, n = row[:5]
    values = (i, source, lang, n if n is None else n + add, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level, at):
    """Root, and for the node at ``at`` its siblings with their side."""
    way = []
    while len(level) > 1:
        if at ^ 1 < len(level):
            way.append((level[at ^ 1], at & 1))
        else:
            way.append(None)
        level, at = [h(*level[i : i + 2]) for i in range(0, len(level), 2)], at >> 1
    return level[0], way


def expected(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    for v in trees.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    roots = [climb([leaf(r) for r in trees[v]], 0)[0] for v in langs]
    out = []
    for k, v in enumerate(langs):
        for at, r in enumerate(trees[v]):
            subroot, own = climb([leaf(x) for x in trees[v]], at)
            root, above = climb(roots, k)
            way = own + above
            change = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = leaf(r, int(change))
            for s in way:
                end = h(end) if s is None else h(s[0], end) if s[1] else h(end, s[0])
            out.append((r[0], leaf(r), subroot, root, h(*[s[0] for s in way if s]), end, end == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, f"text {i} é" * rng.randrange(4), rng.choice(["en", "en", "en", "de", None, "z"]), rng.choice(["a", None, ""]), rng.choice([None, 3, 200])) for i in range(150)]
    out += [(500, "alone", "only", "s", 5), (501, None, "", None, None), (None, "no id", "en", "s", 5), (None, "no id", None, "s", 5), (7, "x" * 300_000, "en", "s", 300_000)]
    return out + [(600, "again", "de", "s", 5)] * 3 + [(600, "other", "de", "s", 5)]


@pytest.mark.parametrize("stride", [1, 3, 10])
def test_against_brute_force(spark, rows, stride):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mm.document_proofs(docs, stride)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_against_sql(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mm.SQL)
    names = [d[0] for d in want.description]
    got = mm.op12_octopus_manifest(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_edges(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows[:20]], SCHEMA + ", leaf string, pos int, verified boolean")
    assert sorted(map(tuple, mm.document_proofs(docs).collect()), key=repr) == expected(rows[:20])
    one = mm.document_proofs(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()
    assert one[0]["root"] == one[0]["subroot"] == one[0]["leaf"] == one[0]["folded_root"] and one[0]["proof_sha256"] == h("")
    assert mm.document_proofs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_groups(spark):
    rows = [(i, "t", f"lang{i}", "s", 1) for i in range(300)]
    assert sorted(map(tuple, mm.document_proofs(spark.createDataFrame(rows, SCHEMA), 3).collect()), key=repr) == expected(rows)


def test_least_nodes_are_fetched():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 70))
        held = np.flatnonzero(rng.random(n) < rng.random())
        if not len(held):
            continue
        found, level, known = mm.missing(n, held), 0, set(held.tolist())
        while mm.size_at(n, level) > 1:  # a node is missing only if nothing held lies below it, and its sibling is known
            for at, i in found:
                if at == level:
                    assert i not in known and i ^ 1 in known and not any(i << at <= x < (i + 1) << at for x in held)
            known = known | {i for at, i in found if at == level}
            known = {i >> 1 for i in known if i ^ 1 in known or i ^ 1 >= mm.size_at(n, level)}
            level += 1
        assert known == {0}


def test_proofs_of_a_few_leaves(spark):
    leaves = spark.createDataFrame([("t", 100, i, h(str(i))) for i in range(100)], "tree string, n long, pos long, digest string")
    nodes = mm.tree_nodes(leaves, 1, 3).select("tree", "level", "idx", "digest")
    nodes = nodes.unionByName(leaves.selectExpr("tree", "0 as level", "pos as idx", "digest"))
    got = mm.proofs(leaves.where("pos in (3, 4, 50, 99)"), nodes, 3).collect()
    root = climb([h(str(i)) for i in range(100)], 0)[0]
    assert sorted(r["pos"] for r in got) == [3, 4, 50, 99]
    for r in got:
        want = [s and s[0] for s in climb([h(str(i)) for i in range(100)], r["pos"])[1]]
        assert r["siblings"] == want and mm.folded(h(str(r["pos"])), r["pos"], want) == root

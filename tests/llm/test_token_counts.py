import random

import numpy as np

from tarnwork.llm.token_counts import op10_separator_scan, scan_token_files, token_files
from tarnwork.llm.tokens import encoder, vocabulary_path


def brute(blocks, end):
    out = {}
    for file_id in {f for f, *_ in blocks}:
        ids = [x for f, b, t in sorted((x for x in blocks), key=lambda x: (x[0], x[1])) if f == file_id for x in (np.frombuffer(t, "<u2") if t else [])]
        at, docs = 0, []
        for i, x in enumerate(ids):
            if x == end:
                docs.append((at, i - at, True))
                at = i + 1
        if at < len(ids):
            docs.append((at, len(ids) - at, False))
        out[file_id] = docs
    return out


def test_scan_against_brute_force(spark):
    rng = random.Random(9)
    blocks = []
    for file_id in range(4):
        for block in range(600):
            n = rng.choice([0, 1, 3, 8])
            tokens = [9 if rng.random() < (0.02 if file_id == 1 else 0.2) else rng.randrange(10, 60000) for _ in range(n)]
            blocks.append((file_id, block * 2, None if not n and block % 2 else np.array(tokens, "<u2").tobytes()))
    files = spark.createDataFrame(blocks, "file_id int, block long, tokens binary").repartition(7)
    got = {}
    for r in sorted(scan_token_files(files, 9).collect(), key=lambda r: (r["file_id"], r["ordinal"])):
        assert r["ordinal"] == len(got.setdefault(r["file_id"], []))
        got[r["file_id"]].append((r["start"], r["n_tokens"], r["closed"]))
    assert got == {f: d for f, d in brute(blocks, 9).items() if d}
    assert scan_token_files(files.limit(0)).count() == 0


def test_documents(spark, tmp_path):
    encode = encoder(vocabulary_path(), special=False)
    texts = ["a b c", None, "", "long text " * 500, "a b c", "<|endoftext|> inside"] * 3
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, block int, tokens string").coalesce(2)
    files = token_files(docs, block_tokens=64)
    assert all(len(r["tokens"]) <= 128 for r in files.collect())
    got = sorted(r["n_tokens"] for r in scan_token_files(files).collect())
    assert got == sorted(len(encode(t or "")) for t in texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op10_separator_scan(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(encode(t or "")) for i, t in enumerate(texts)}


def test_repeated_ids_and_very_long_texts(spark, tmp_path):
    encode = encoder(vocabulary_path(), special=False)
    rows = [(7, "a b"), (7, "a b"), (None, "c"), (8, "word " * 150_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in op10_separator_scan(spark, str(tmp_path)).collect())
    assert got == sorted((i or 0, len(encode(t))) for i, t in rows)

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm.lgs_packing import CAPACITY, pack, pack_documents, plan_packing
from tarnwork.llm.tokens import encoder, vocabulary_path


def check_plan(histogram, capacity, groups):
    rooms, seen = {}, {}
    for length, rank, n, first, offset in plan_packing(histogram, capacity, groups):
        for i in range(n):
            rooms.setdefault(first + i, []).append((offset, length))
            assert (length, rank + i) not in seen
            seen[length, rank + i] = True
    assert len(seen) == sum(histogram.values())
    assert all((n, r) in seen for n, k in histogram.items() for r in range(k))
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.integers(1, 30))
def test_plan_places_every_length_once(histogram, groups):
    used = check_plan(histogram, 64, groups)
    assert used >= -(-sum(n * k for n, k in histogram.items()) // 64)


def test_plan_is_tight():
    rng = random.Random(4)
    histogram = {}
    for _ in range(5000):
        n = min(CAPACITY, int(rng.lognormvariate(6, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    least = -(-sum(n * k for n, k in histogram.items()) // CAPACITY)
    assert check_plan(histogram, CAPACITY, 512) <= least * 1.01 + 2


def test_ids_equal_those_of_the_json_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder(vocabulary_path())
    rng = random.Random(6)
    texts = ["", " ", "a  b\n\n c", "l'été naïve straße 12345 ###&&&", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|><|endoftext|>\n x", "<|endoftext|", "<|ENDOFTEXT|>", "日本語 テキスト", "\x85\xa0 \x1c\t", "😀 x" * 5, "᠎​﻿", "don't we'll I'D"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x2000, 0x2070), rng.randrange(0x3040, 0x30FF), 10, 13, 9])) for _ in range(80)) for _ in range(300)]
    for text in texts:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids
        assert 50256 not in encoder(vocabulary_path(), special=False)(text)


def test_ids_of_texts_beyond_the_readers_own_splitting():
    encode = encoder(vocabulary_path())
    few, many = encode("x" + " " * 500 + "y"), encode("x" + " " * 500_000 + "y")
    assert len(many) == len(few) + 499_500 and many[:2] == few[:2] and many[-2:] == few[-2:]
    assert encode(" " * 500_000 + "<|endoftext|>")[-1] == 50256


def test_documents(spark):
    encode = encoder(vocabulary_path())
    rng = random.Random(7)
    texts = ["word " * rng.randrange(0, 3000) for _ in range(60)] + [None, "", "short", "short"] + ["copy copy"] * 80 + ["long é " * 4000, "ends <|endoftext|> here"]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(0, texts[0], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long").repartition(5)
    got = pack_documents(docs).collect()
    want, tokens = [], 0
    for i, t, _ in rows:
        ids = np.array(encode(t or "") + [0], "<u4")
        tokens += len(ids)
        head = len(ids) % CAPACITY or CAPACITY
        cuts = [0, *range(head, len(ids) + 1, CAPACITY)] if len(ids) > CAPACITY else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    rooms = {}
    for r in got:
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert len(rooms) <= -(-tokens // CAPACITY) + 2
    assert pack_documents(docs.limit(0)).count() == 0


def test_hot_length_is_ranked_in_parts(spark):
    rows = [(i % 700 if i % 5 else None, i, 2048 if i % 3 else 7) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = pack(pieces, rank_rows=100).collect()
    assert len(got) == len(rows) and len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows)
    assert len({r["sequence_id"] for r in got if r["length"] == 2048}) == sum(n == 2048 for _, _, n in rows)


def test_lengths_out_of_range_raise(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 0, 5000)], "doc_id long, piece int, length long"))

import itertools
import random
import zlib

from tarnwork.llm.hilbert_shards import curve_tables, document_metadata, hilbert_shards, write_shards


def test_curve_visits_every_cell_by_unit_steps():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        digit, after = curve_tables(n)
        cells = {}
        for x in itertools.product(range(1 << bits), repeat=n):
            h = s = 0
            for level in range(bits - 1, -1, -1):
                corner = sum(((x[j] >> level) & 1) << j for j in range(n))
                h, s = (h << n) | digit[s * (1 << n) + corner], after[s * (1 << n) + corner]
            cells[h] = x
        assert sorted(cells) == list(range(1 << (n * bits)))
        assert all(sum(abs(p - q) for p, q in zip(cells[i], cells[i + 1])) == 1 for i in range(len(cells) - 1))


def rows():
    out = [(i, f"text {i} é" * (i % 5 + 1), f"s{i % 3}", "en", "old") for i in range(100)]
    out += [(200 + i, "same", "hot", None, "old") for i in range(60)]
    return out + [(7, "again", None, "de", None)] * 3 + [(None, None, None, None, None)] * 2 + [(300, "", "", "", "")]


def test_shards_of_documents(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, lang string, shard string")
    meta = document_metadata(docs)
    got = hilbert_shards(meta, ["source", "lang"], ["size", "doc_id"]).collect()
    assert len(got) == len(rows())
    want = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    by_curve = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in by_curve] == sorted(r["curve"] for r in got)


def test_clashing_columns_empty_table_and_files(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, lang string, shard string")
    kept = hilbert_shards(docs.select("doc_id", "source", "shard"), ["source"], ["doc_id"], n_shards=3)
    assert kept.columns == ["doc_id", "source", "curve", "shard", "slot"]
    write_shards(kept, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows())
    assert hilbert_shards(document_metadata(docs.limit(0)), ["source"], ["size"]).count() == 0


def test_a_range_on_any_dimension_reads_few_shards(spark):
    rng = random.Random(5)
    data = [(i, f"source{rng.randrange(40):02}", rng.choice("abcd") * 2, int(rng.lognormvariate(6, 1))) for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, size long")
    got = hilbert_shards(docs, ["source", "lang"], ["size", "doc_id"], n_shards=64).collect()
    for name, most in (("source", 45), ("lang", 45), ("size", 45), ("doc_id", 45)):
        values = sorted(r[name] for r in got)
        lo, hi = values[0], values[len(values) // 8]  # an eighth of the rows
        bounds = {}
        for r in got:
            a, b = bounds.get(r["shard"], (r[name], r[name]))
            bounds[r["shard"]] = (min(a, r[name]), max(b, r[name]))
        assert sum(a <= hi and b >= lo for a, b in bounds.values()) <= most, name


def test_many_categories_and_very_long_text(spark):
    data = [(i, "long " * 300_000 if i == 5 else "t", f"{i * 7919 % 5000:04}", None, None) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, shard string")
    got = hilbert_shards(document_metadata(docs), ["source"], ["doc_id"], n_shards=16).collect()
    assert len(got) == 3000 and max(r["size"] for r in got) == 1_500_001
    sources = {}
    for r in got:
        sources.setdefault(r["shard"], []).append(r["source"])
    assert sum(int(max(v)) - int(min(v)) for v in sources.values()) / len(sources) < 2500


def shards_of(rows, measures):
    out = {}
    for r in hilbert_shards(rows, ["source"], measures).collect():
        out.setdefault(r["shard"], []).append(r)
    return out


def test_categories_with_a_common_prefix(spark):
    rng = random.Random(6)
    data = [(i, f"https://{rng.randrange(1500):04}") for i in range(6000)]
    names = lambda data, measures: {k: {r["source"][-4:] for r in rows} for k, rows in shards_of(spark.createDataFrame(data, "doc_id long, source string"), measures).items()}
    alone, both = names(data, []), names(data, ["doc_id"])
    assert len(alone) == 8 and max(map(len, alone.values())) <= 375
    assert len(both) == 8 and max(map(len, both.values())) <= 750
    plain = names([(i, s[-4:]) for i, s in data], ["doc_id"])  # the prefix changes nothing but the order inside of cells
    assert all(len(both[k] ^ plain[k]) < 100 for k in range(8))


def test_equal_texts_stand_together(spark):
    rng = random.Random(7)
    data = [(i, f"text {rng.randrange(300)}" if i % 3 else "hot", f"s{rng.randrange(9)}", rng.choice(["a", "b"])) for i in range(3000)]
    meta = document_metadata(spark.createDataFrame(data, "doc_id long, text string, source string, lang string"))
    got = hilbert_shards(meta, ["source", "lang"], ["size", "doc_id"], group=["text_crc32", "size"]).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    shards, runs, last = {}, 0, None
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
        runs, last = runs + (r["text_crc32"] != last), r["text_crc32"]
    assert runs == len(shards)  # each group is one run of the order
    assert sum(len(s) > 1 for s in shards.values()) <= 7

import random
import zlib

import numpy as np

from tarnwork.llm import language_id as li


def corpus():
    rng = random.Random(10)
    parts = {"aa": ["tion", "ing", "the", "er"], "bb": ["ção", "que", "os", "ar"], "cc": ["heit", "sch", "ü", "en"]}
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([2, 20, 100])))
        rows.append((i, text, lang))
    return rows


def counts_of(text):
    """order -> context -> byte -> count, with spaces before the text."""
    padded, out = b"   " + text, {k: {} for k in range(4)}
    for i in range(3, len(padded)):
        for k in range(4):
            of = out[k].setdefault(padded[i - k : i], {})
            of[padded[i]] = of.get(padded[i], 0) + 1
    return out


def distribution(counts, context):
    """Probabilities of all 256 bytes after three, by prediction by partial matching with exclusion."""
    p, left, excluded = [0.0] * 256, 1.0, set()
    for k in (3, 2, 1, 0):
        here = {b: n for b, n in counts[k].get(context[3 - k :], {}).items() if b not in excluded}
        if not here:
            continue
        whole = sum(here.values()) + len(here)
        for b, n in here.items():
            p[b] = left * n / whole
        left *= len(here) / whole
        excluded |= set(here)
    for b in set(range(256)) - excluded:
        p[b] = left / (256 - len(excluded))
    return p


def grams_of(text):
    v = np.frombuffer(b"   " + text, np.uint8).astype(np.int64)
    return np.unique((v[:-3] << 24) | (v[1:-2] << 16) | (v[2:-1] << 8) | v[3:], return_counts=True)


def test_code_lengths_against_a_distribution_that_sums_to_one():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abca ") for _ in range(400)).encode(), "Völlig andere Zeichen: aß, bö!".lower().encode()]
    model = li.build_model({"x": grams_of(texts[0]), "y": grams_of(texts[1])}, {"x": 1, "y": 1})
    for k, trained in enumerate(texts):
        counts = counts_of(trained)
        for t in (b"abcab z", b"a", b"zzz", texts[0][:50], texts[1], bytes(range(256))):
            padded, total = b"   " + t, 0.0
            for i in range(3, len(padded)):
                p = distribution(counts, padded[i - 3 : i])
                assert abs(sum(p) - 1) < 1e-9
                total -= np.log2(p[padded[i]])
            assert abs(li.code_lengths(model, [t])[0, k] - total) < 1e-3 * max(1, len(t) / 50)


def test_costs_of_one_context_sum_to_one():
    rng = random.Random(13)
    text = "".join(rng.choice("the quick brown fox") for _ in range(2000)).encode()
    tree = li.Tree(*grams_of(text))
    for context in (b"the", b"he ", b"zzz", b"   ", b"qui", b"\xff\x00q"):
        gram = (int.from_bytes(context, "big") << 8) + np.arange(256, dtype=np.int64)
        assert abs(np.exp2(-tree.bits(gram)).sum() - 1) < 1e-9


def test_long_texts_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(12)
    text = "".join(rng.choice("abcd e") for _ in range(5000)).encode()
    model = li.build_model({"x": grams_of(text)}, {"x": 1})
    whole = li.code_lengths(model, [text, b"", b"ab"])
    monkeypatch.setattr(li, "_PIECE", 64)
    assert np.allclose(whole, li.code_lengths(model, [text, b"", b"ab"]), rtol=1e-5)


def test_other_languages_and_noise_are_rejected(spark):
    rng = random.Random(14)
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxzäöüß ") for _ in range(900)) for _ in range(20)]
    rows = [(*r, "z") for r in corpus()] + [(2000 + i, t, None, "z") for i, t in enumerate(noise)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    assert sorted(r["doc_id"] for r in li.identified(docs).collect()) == list(range(240))


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "bb"), (1003, "the er ing", None), (None, "tion the", "aa"), (1003, "the er ing", None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, score string")
    from pyspark.sql import functions as F

    model = li.train(docs.where(~li.held_out(F.col("doc_id"))))
    got = li.predict(docs.select("doc_id", "lang", li.held_out(F.col("doc_id")).alias("held_out"), "text"), model, ["doc_id", "lang", "held_out"]).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"] and (r["doc_id"] or 0) < 1000]
    assert len(out) > 40 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by_id[1003]["lang_pred"] == "aa" and 0 < by_id[1003]["score"] <= 1
    kept = li.identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert {r["lang"] for r in kept.where("doc_id = 1003").collect()} == {"aa"}
    assert li.train(docs.limit(0)) is None
    assert li.predict(docs, None, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_shares_need_no_table_and_no_broadcast_is_left(spark, monkeypatch):
    """Rows that the driver turns into a table pass through Python workers of their own on the executors, which stay there."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    docs.count()
    sent, gone = [], []
    broadcast = spark.sparkContext.broadcast

    def watched(value):
        sent.append(broadcast(value))
        destroy = sent[-1].destroy
        sent[-1].destroy = lambda *a: (gone.append(len(sent)), destroy(*a))
        return sent[-1]

    monkeypatch.setattr(type(spark), "createDataFrame", None)
    monkeypatch.setattr(spark.sparkContext, "broadcast", watched)
    model = li.train(docs, measure=True)
    assert model.languages == ["aa", "bb", "cc"] and (model.usual > 0).all()
    assert len(sent) == len(gone) == 1


def test_no_language_is_lost(spark):
    """Very many languages, most with one document."""
    rng = random.Random(15)
    alphabets = ["".join(chr(0x4E00 + 40 * k + j) for j in range(12)) for k in range(300)]
    rows = [(k, " ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(30)), f"l{k}") for k, a in enumerate(alphabets)]
    rows += [(1000 + i, "the of and to in " * 40, "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for measure in (False, True):
        model = li.train(docs, measure=measure)
        assert len(model.languages) == 301
    got = li.predict(docs, model, ["doc_id", "lang"]).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
    few = li.train(docs, train_bytes=301)  # a byte a language: one document each
    assert len(few.languages) == 301

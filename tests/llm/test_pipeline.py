import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwork.llm.lgs_packing import CAPACITY

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(17)
    parts = {"en": ["tion", "ing", "the", "er"], "de": ["heit", "sch", "ung", "en"]}
    docs, labels = [], []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 200)))
        docs.append((i, text, lang if i % 9 else None, f"s{i % 4}", len(text)))
        labels.append((i, int(i % 3 > 0), int(i % 10 == 0)))
    for i in range(160, 200):
        docs.append((i, docs[i - 160][1], "en", "copy", len(docs[i - 160][1])))
    docs.append((200, docs[5][1] + " password = abcdefabcdefabcdef", "en", "s", 10))
    docs += [(201, None, "en", "s", None), (202, "123 !!", None, "s", 6)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        seen.append(docs.collect())
    assert {r["doc_id"] for r in seen[0]} == {i for i, *_ in rows} - {201, 202}
    assert all(r["lang"] for r in seen[0])
    kept = {r["doc_id"] for r in seen[1]}
    assert not kept & set(range(160, 200)) and len(kept) >= 150
    assert len(seen[2]) == len(seen[1])
    texts = {r["doc_id"]: r["text"] for r in seen[2]}
    assert not any(re.search(r"password = \w{12}", t) for t in texts.values())
    if 200 in texts:
        assert texts[200].endswith("[SECRET]")
    assert {r["doc_id"] for r in seen[3]} <= kept
    lengths = {}
    for r in seen[4]:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert max(lengths.values()) <= CAPACITY


def test_workers_get_small_batches(spark, folder, monkeypatch):
    """Stages end Arrow batches by their bytes, unless the session has a bound of its own."""
    path, _ = folder
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(docs, *_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

        return docs.sparkSession.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text")).mapInArrow(run, "size long")

    for name in ("identified", "keep_one_copy", "mixed", "pack_documents"):
        monkeypatch.setattr(pipeline, name, sizes)
    for (name, stage), own in zip(pipeline.STAGES, [None, str(1 << 30), None, None, None], strict=True):
        session = spark.newSession()
        if own:
            session.conf.set(setting, own)
        if name == "secret scans":  # has no Python
            continue
        found = [r["size"] for r in stage(session, session.read.parquet(f"{path}/documents.parquet"), path).collect()]
        assert sum(found) > 18_000_000 and (max(found) > 18_000_000 if own else max(found) < 4_500_000)


def test_run(spark, folder):
    path, _ = folder
    out = pipeline.run(spark, path)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100

import datetime

import pytest
from pyspark.sql import functions as F

from tarnwork.streaming import incremental

ROW = "item long, at timestamp, digest string"
START = datetime.datetime(2024, 1, 1)


def rereads(spark, path, files=5, hours=20):
    """Files of a day each; each begins 20 hours before the one before ended. Every fourth item changes in the reread."""
    rows = []
    for f in range(files):
        first = f * 24 - (hours if f else 0)
        part = [(h, START + datetime.timedelta(hours=h), "b" if f and h < f * 24 and h % 4 == 0 else "a") for h in range(first, f * 24 + 24)]
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(f"{path}/{f}")
        rows += part
    return rows


def started(spark, path, out, checkpoint):
    rows = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    return incremental.stream_revisions(rows, "at", ["item", "digest"], out, checkpoint)


def test_killed_and_restarted_runs_write_each_revision_once(spark, tmp_path, monkeypatch):
    rows = rereads(spark, f"{tmp_path}/in")
    out, checkpoint, write, died = f"{tmp_path}/out", f"{tmp_path}/checkpoint", incremental._write_batch, []

    def dying(df, where, batch):
        write(df, where, batch)
        if batch not in died and batch in (1, 3):  # its rows are there, but the batch isn't committed
            died.append(batch)
            raise RuntimeError("lost")

    monkeypatch.setattr(incremental, "_write_batch", dying)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            started(spark, f"{tmp_path}/in", out, checkpoint).awaitTermination()
    started(spark, f"{tmp_path}/in", out, checkpoint).awaitTermination()
    got = sorted((r["item"], r["digest"]) for r in spark.read.parquet(out).collect())
    assert died == [1, 3]
    assert got == sorted({(i, d) for i, _, d in rows})
    started(spark, f"{tmp_path}/in", out, checkpoint).awaitTermination()  # nothing new
    assert spark.read.parquet(out).count() == len(got)


def test_counts_go_to_files_and_late_rows_change_their_window(spark, tmp_path):
    rows = rereads(spark, f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    out = f"{tmp_path}/out"
    incremental.stream_counts(spark, f"{tmp_path}/in/*", schema, "at", "digest", f"{tmp_path}/checkpoint", out, delay="48 hours").awaitTermination()
    got = {(r["window"]["start"], r["digest"]): r["count"] for r in incremental.latest_counts(spark, out, "digest").collect()}
    want = {}
    for _, at, d in rows:
        k = (at.replace(hour=0), d)
        want[k] = want.get(k, 0) + 1
    assert got == want
    assert spark.read.parquet(out).select(F.col("batch")).distinct().count() >= 1

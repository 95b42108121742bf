"""Tables written to the folder that all executors share.

A long plan is cut by writing its rows once and reading them again. The files survive lost executors, so a later
job never has to repeat the work above the cut.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT = "/tmp/checkpoints"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes after which an Arrow batch of rows for a Python worker ends.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one under /tmp only where it is unset and Spark runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"{_LOCAL_DEFAULT}/{spark.sparkContext.applicationId}"
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


_cleaned: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """End this session's Arrow batches at ``BATCH_BYTES``, unless the setting has a value already.

    By default a batch ends at 10,000 rows or 64 MB. Executor and Python worker hold one for each task, with what they make of it,
    and keep that memory.
    """
    spark.conf.set(_ARROW_BYTES, spark.conf.get(_ARROW_BYTES, str(BATCH_BYTES)))


def written(df: DataFrame, tag: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a frame that reads it.

    An empty frame keeps its schema. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Folds over rows in order, for what depends on earlier results of the same operator and so is no window.

Rows are dealt by key and sorted inside partitions; one pass over Arrow batches carries the key and its state, so a
key with very many rows takes no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], reads: list[str], out: str, kind: DataType, begin: Any, step: Callable[..., tuple[Any, Any]]) -> DataFrame:
    """``df`` with column ``out``: ``step(state, *reads)`` gives (state, value) for each row of a key in order.

    The first row of a key has the state ``begin``. Nulls in ``order`` come last; a null key is a key.
    """
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in order])
    at_keys, at_reads = [df.columns.index(c) for c in keys], [df.columns.index(c) for c in reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = None
        state = begin
        for b in batches:
            found = []
            of_rows = zip(*[b.column(i).to_pylist() for i in at_reads])
            for now, values in zip(zip(*[b.column(i).to_pylist() for i in at_keys]), of_rows):
                if now != key:
                    key, state = now, begin
                state, value = step(state, *values)
                found.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string() if kind.simpleString() == "string" else pa.bool_())], [*b.schema.names, out])

    return rows.mapInArrow(run, StructType(df.schema.fields).add(out, kind))

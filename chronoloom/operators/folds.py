"""Ordered scans with state: for rules that start anew at each cut, which no window function expresses.

Rows are dealt by key and sorted within partitions; a task reads them as they come and holds one key's state, so a key may have
any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship


def ordered_scan(df: DataFrame, key: str, order: list[str], reads: list[str], step: Callable[[Any, tuple], tuple[Any, int]], out: str) -> DataFrame:
    """df with a column out: step takes a key's state (None at first) and the columns it reads, and gives both anew."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        last, state = None, None
        for batch in batches:
            keys, rows = batch.column(key).to_pylist(), zip(*(batch.column(c).to_pylist() for c in reads), strict=True)
            found = []
            for k, row in zip(keys, rows, strict=True):
                if k != last:
                    last, state = k, None
                state, value = step(state, row)
                found.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=schema.names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)

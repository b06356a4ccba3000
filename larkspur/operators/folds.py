"""Folds over the sorted rows of a key that no window function expresses, in constant memory for each key."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def sorted_fold(df: DataFrame, key: list[str], order: list[str], values: list[str], out: list[StructField], begin: Callable, step: Callable) -> DataFrame:
    """Rows (key, order, values) of df with the columns `out` that the fold gives each of them.

    Rows of a key come sorted by `order`, batch by batch; step(state, *order and
    values) returns (new state, out values), begin() the state of a new key.  Only
    the state of one key is held, however many rows it has.
    """
    names = list(dict.fromkeys([*key, *order, *values]))
    rows = df.select(*names).repartition(*key).sortWithinPartitions(*key, *order)
    schema = StructType([*rows.schema.fields, *out])
    kinds = [f.type for f in to_arrow_schema(StructType(out))]
    n = len(key)

    def run(batches):
        last, state = None, None
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != last:
                    last, state = row[:n], begin()
                state, new = step(state, *row[n:])
                made.append(new)
            cols = zip(*made, strict=True) if made else [() for _ in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], schema.names)

    return rows.mapInArrow(run, schema)

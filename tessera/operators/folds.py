"""Ordered folds: state carried along the sorted rows of a key, in one streaming pass."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], uses: list[str], start: Callable, step: Callable, name: str, kind: T.DataType) -> DataFrame:
    """df with ``name``: for each key ``state, value = step(state, *uses)`` over its rows in order, from ``start()``.

    Rows are dealt by key and sorted (a sort that spills), and a task streams them, so a key of any
    number of rows takes linear time and the memory of its state.  The fold has an order, so one
    key's rows pass through one task; give finer keys where the fold does not cross them.
    """
    spark = df.sparkSession
    dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow = to_arrow_type(kind)

    def run(stream):
        at, state = None, None
        for batch in stream:
            columns = {c: batch.column(c).to_pylist() for c in {*keys, *uses}}
            out = []
            for key, values in zip(zip(*(columns[k] for k in keys), strict=True), zip(*(columns[u] for u in uses), strict=True), strict=True):
                if key != at:
                    at, state = key, start()
                state, value = step(state, *values)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=schema.names)

    return dealt.mapInArrow(run, schema)

"""Columns computed in Python beside the untouched columns of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def append_columns(df: DataFrame, inputs: list[str], fn: Callable, fields: list[T.StructField]) -> DataFrame:
    """``df`` with new columns: ``fn`` gets the ``inputs`` of a batch as lists and returns one list for each field.

    The other columns pass as Arrow arrays, so no value of theirs changes on the way (pandas would turn bigints beside nulls
    into doubles). Columns of ``df`` with the fields' names are replaced."""
    rows = df.drop(*[f.name for f in fields])
    at = [rows.columns.index(c) for c in inputs]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*rows.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(*[batch.column(i).to_pylist() for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, kind, from_pandas=True) for x, kind in zip(new, kinds)]], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))

"""Columns appended to whole rows by a function of the text, in one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.llm.common import handing_back


def appended(df: DataFrame, text_col: str, make: Callable[[], Callable[[str | None], tuple[Any, ...]]], fields: str) -> DataFrame:
    """df with the columns of ``fields`` (a schema text) after its own.

    ``make`` is called once in each task and gives the function that makes a row's values.
    New names must not be among df's columns.
    """
    more = StructType.fromDDL(fields)
    if clash := set(more.names) & set(df.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    at, types = df.columns.index(text_col), [f.type for f in to_arrow_schema(more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = make()
        for batch in batches:
            rows = [value(t.as_py()) for t in batch.column(at)]
            new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *more.names])

    return df.mapInArrow(handing_back(run), StructType([*df.schema.fields, *more.fields]))

"""New columns computed in Python from one text column, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rinsewell.functions.names import col

from .tables import without
from .words import slices


def with_text(df: DataFrame, names: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns ``names`` of ``df``, the place of the text among them, and if it is not, one column more."""
    own = [col(name) for name in names]
    if text in names and isinstance(df.schema[text].dataType, T.StringType):
        return df.select(*own), names.index(text)
    return df.select(*own, col(text).cast("string").alias("__rw_text")), len(names)


def added(df: DataFrame, text: str, new: dict[str, tuple[T.DataType, pa.DataType]], rows, done=None) -> DataFrame:
    """``df`` with columns computed from its text column by ``rows(list of values) -> list of tuples``;
    ``done`` is called at the end of each task."""
    base = without(df, *new)
    schema = T.StructType([*base.schema.fields, *(T.StructField(name, kind[0]) for name, kind in new.items())])
    names, width = list(schema.names), len(base.columns)
    source_rows, source = with_text(df, base.columns, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                got = list(zip(*rows(part.column(source).to_pylist()), strict=True))
                columns = [pa.array(values, kind[1]) for values, kind in zip(got, new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns], names)
        if done:
            done()

    return source_rows.mapInArrow(run, schema)

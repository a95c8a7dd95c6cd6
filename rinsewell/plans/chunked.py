"""Cleaning a table in chunks of consecutive rows, each as a table of its own."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import col, join_types, to_type
from ..sources.csv import infer_types
from ..sources.order import ORDER_COLUMN
from .clean import CHUNK_COLUMN, STEP, CleanResult, clean

BLOCK = 1 << 20  # positions that are ranked by one task


def chunk_of(row_number: Column, chunk_size: int) -> Column:
    """The chunk of a row numbered from 0."""
    return F.floor(row_number / F.lit(chunk_size)).cast("long")


def number_rows(df: DataFrame, into: str) -> DataFrame:
    """Number rows from 0 in table order, without a global sort.

    A block is what a position has in common but for its last digits: part of a file split, of at most ``BLOCK``
    positions. Rows are ranked by position within their block, and each adds the rows of all blocks before its own,
    which are a small table. So the numbers have no gaps and follow the positions, wherever the rows are by now.
    """
    place = F.col(ORDER_COLUMN)
    fields = df.schema[ORDER_COLUMN].dataType.fieldNames()
    blocks = {f"__{name}": place[name] for name in fields if name in ("file", "block")}
    blocks["__rows"] = F.floor(place["row"] / BLOCK)
    rows = df.withColumns(blocks)
    earlier = Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*blocks).agg(F.count("*").alias("size"))
    sizes = sizes.select(*blocks, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*blocks).orderBy(place)) - 1
    numbered = rows.withColumn("__rank", rank).join(sizes, list(blocks))
    return numbered.select(*map(col, df.columns), (F.col("__rank") + F.col("__before")).alias(into))


def clean_chunks(
    df: DataFrame,
    steps: Iterable[STEP],
    chunk_size: int,
    row_number: Column | None = None,
    order_by: str | list[str] | None = None,
    infer: bool = False,
) -> CleanResult:
    """Clean each chunk of ``chunk_size`` rows separately and put the results together.

    Duplicates in different chunks survive, and a column that is empty in some chunks is blank
    there. ``row_number`` counts rows from 0; tables from ``read_table`` are numbered here. ``infer`` types text
    columns by what they hold, chunk by chunk (see ``infer_types``).
    """
    if row_number is None:
        if ORDER_COLUMN not in df.columns:
            raise ValueError("clean_chunks: give row_number, or a table read by read_table")
        df = number_rows(df, CHUNK_COLUMN)
        row_number = F.col(CHUNK_COLUMN)
    chunk = chunk_of(row_number, chunk_size)
    if infer:
        df = infer_types(df, scope=chunk)
    return clean(df, steps, order_by, {"chunk": chunk})


def union_chunks(parts: list[DataFrame]) -> DataFrame:
    """Put results together by column name; a column that a part lacks is null there.

    Where parts give a column different types, it gets the least type that holds them all: text, if there is none
    closer. Any union of tables is possible, and no cell is lost.
    """
    types: dict[str, list] = {}
    for part in parts:
        for field in part.schema.fields:
            types.setdefault(field.name, []).append(field.dataType)
    common = {name: join_types(found) for name, found in types.items()}
    typed = [
        part.select(*[to_type(col(f.name), f.dataType, common[f.name]).alias(f.name) for f in part.schema.fields])
        for part in parts
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)

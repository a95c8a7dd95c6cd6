"""The hidden input position that defines first and last."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ORDER_COLUMN = "__position"


def with_position(df: DataFrame, row_index: bool) -> DataFrame:
    """Add the position of each row in its file, files in order of their path.

    Parquet knows the row index. For text formats, rows of one file split are numbered by the task
    that reads it; the number grows along the split and comes out the same when a task is repeated.
    """
    file = F.col("_metadata.file_path").alias("file")
    if row_index:
        position = F.struct(file, F.col("_metadata.row_index").alias("row"))
    else:
        block = F.col("_metadata.file_block_start").alias("block")
        position = F.struct(file, block, F.monotonically_increasing_id().alias("row"))
    return df.select("*", position.alias(ORDER_COLUMN))

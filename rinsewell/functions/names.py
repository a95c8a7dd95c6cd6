"""Column references by exact name, and the text form of typed cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def quoted(name: str) -> str:
    """Back-quote a column name, so that dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def as_text(value: Column, dtype: T.DataType) -> Column:
    """The text of a cell as a Python user sees it: ``True``, ``12345678.5``, ``2024-01-05 00:00:00``.

    Spark prints doubles from 1e7 on, and those below 1e-3, in scientific notation. Python starts at
    1e16 and 1e-4, so the range between is printed through a decimal that holds every digit.
    """
    if is_text(dtype):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        plain = value.cast("string")
        digits = F.regexp_replace(plain.try_cast("decimal(38,20)").cast("string"), r"0+\z", "")
        size = F.abs(value)
        positional = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
        return F.when(positional, F.regexp_replace(digits, r"\.\z", ".0")).otherwise(plain)
    return value.cast("string")

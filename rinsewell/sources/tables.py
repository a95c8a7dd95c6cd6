"""Reading and writing tables by format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import col
from .csv import read_csv
from .json import read_json
from .order import ORDER_COLUMN, with_position
from .yaml import read_yaml, yaml_lines

# File extension -> format.
EXTENSIONS = {
    "csv": "csv",
    "json": "json",
    "jsonl": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "parquet": "parquet",
    "orc": "orc",
}


def format_of(path: str) -> str:
    """The format a path names by its extension; CSV where it names none."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return EXTENSIONS.get(extension, "csv")


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Read ``csv``, ``json``, ``yaml``, ``parquet`` or ``orc`` with a hidden position column."""
    kind = (format or format_of(path)).lower()
    if kind == "json":
        return read_json(spark, path, **{"lines": path.endswith(".jsonl"), **options})
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "yaml":
        return read_yaml(spark, path, **options)
    if kind == "parquet":
        return _no_nan(with_position(spark.read.parquet(path), row_index=True))
    if kind == "orc":
        return _no_nan(with_position(spark.read.orc(path), row_index=False))
    raise ValueError(f"unsupported format: {kind!r}")


def _no_nan(df: DataFrame) -> DataFrame:
    """NaN means null."""
    floating = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.select(
        *[
            F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floating else col(n)
            for n in df.columns
        ]
    )


_EPOCH = "TIMESTAMP_NTZ'1970-01-01'"


def _of_type(df: DataFrame, dtype: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, dtype)]


def _csv_text(df: DataFrame) -> DataFrame:
    """Cells as CSV shows them, whatever the session's time zone: ``True``; times as a date where the
    whole column is at midnight; instants in UTC with their offset."""
    cells: dict[str, Column] = {}
    for name in _of_type(df, T.TimestampNTZType):
        if "rinsewell.dates" in df.schema[name].metadata:  # known without looking at the rows
            cells[name] = col(name).cast("date").cast("string")
    local = [name for name in _of_type(df, T.TimestampNTZType) if name not in cells]
    dates: set[str] = set()
    if local:
        midnight = [col(n) == col(n).cast("date").cast("timestamp_ntz") for n in local]
        all_day = df.agg(*[F.coalesce(F.bool_and(m), F.lit(True)) for m in midnight]).first()
        dates = {name for name, found in zip(local, all_day) if found}
    cells |= {n: col(n).cast("date" if n in dates else "string").cast("string") for n in local}
    for name in _of_type(df, T.TimestampType):
        utc = F.timestamp_add("MICROSECOND", F.unix_micros(col(name)), F.expr(_EPOCH))
        cells[name] = F.concat(utc.cast("string"), F.lit("+00:00"))
    for name in _of_type(df, T.BooleanType):
        cells[name] = F.initcap(col(name).cast("string"))
    return df.select(*[cells[n].alias(n) if n in cells else col(n) for n in df.columns])


def _epoch_millis(df: DataFrame) -> DataFrame:
    millis = {n: F.unix_millis(col(n)) for n in _of_type(df, T.TimestampType)}
    for name in _of_type(df, T.TimestampNTZType):
        millis[name] = F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), col(name))
    return df.select(*[millis[n].alias(n) if n in millis else col(n) for n in df.columns])


def write_table(
    df: DataFrame,
    path: str,
    format: str | None = None,
    mode: str = "errorifexists",
    json_epoch: bool = False,
) -> None:
    """Write a directory of files, one per partition; a table without rows keeps its columns.

    CSV: header, null and empty text alike blank. JSON: one object per line, nulls kept;
    ``json_epoch`` writes timestamps as milliseconds since 1970. YAML: sequences of mappings.
    """
    kind = (format or format_of(path)).lower()
    if ORDER_COLUMN in df.columns:
        df = df.drop(ORDER_COLUMN)
    if not df.columns:
        raise ValueError("a table without columns cannot be written")
    if kind == "csv":
        _csv_text(df).write.mode(mode).options(
            header=True,
            emptyValue="",
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        ).csv(path)
    elif kind == "json":
        if json_epoch:
            df = _epoch_millis(df)
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == "yaml":
        # A document is read back by one task, so its size is limited.
        yaml_lines(df).write.mode(mode).option("maxRecordsPerFile", 10_000).text(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "orc":
        df.write.mode(mode).orc(path)
    else:
        raise ValueError(f"unsupported format: {kind!r}")

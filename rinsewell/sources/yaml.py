"""YAML documents, one file each. Parsing needs Python, so it runs in Arrow batches on the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import quoted
from .order import ORDER_COLUMN
from .scratch import scratch_folder


def _yaml():
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading and writing YAML needs the PyYAML package") from error
    return yaml


def _flat(record: dict, prefix: str = "") -> dict:
    """Nested mappings as ``a.b`` keys."""
    flat = {}
    for key, value in record.items():
        if isinstance(value, dict):
            flat.update(_flat(value, f"{prefix}{key}."))
        else:
            flat[f"{prefix}{key}"] = value
    return flat


def _records(text: str) -> list[dict]:
    """The rows of one document: a list gives one each, a mapping one flat row, a scalar one cell."""
    yaml = _yaml()
    # The C parser, where PyYAML was built with it, is many times faster.
    data = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    if data is None:
        return []
    if isinstance(data, dict):
        return [_flat(data)]
    if not isinstance(data, list):
        return [{"0": data}]
    return [item if isinstance(item, dict) else {"0": item} for item in data]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, text in zip(batch["file"], batch["value"]):
            rows = _records(text)
            # Scalars other than JSON's own (dates) are written as their text.
            texts = [json.dumps(row, default=str, ensure_ascii=False) for row in rows]
            yield pd.DataFrame({"file": file, "at": range(len(texts)), "record": texts})


def read_yaml(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """Read YAML files into one table. Without a schema it is merged over all rows, with the columns
    in the order in which their names first appear, and the rows are kept in a scratch table, as files are parsed once."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    records = files.mapInPandas(_parse, "file string, at long, record string")
    place = F.struct("file", "at")
    if schema is None:
        # Parsing is the dear part, and three passes need it.
        folder = scratch_folder(spark)
        records.write.parquet(folder)
        records = spark.read.schema(records.schema).parquet(folder)
        merged = records.agg(F.schema_of_variant_agg(F.try_parse_json("record"))).first()[0]
        if merged is None or not merged.startswith("OBJECT"):
            return spark.createDataFrame([], T.StructType())
        ddl = merged.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
        inferred = spark.range(0).select(F.from_json(F.lit("{}"), ddl).alias("r")).schema["r"].dataType
        keys = records.select(
            place.alias("place"), F.posexplode(F.json_object_keys("record")).alias("slot", "key")
        )
        first = keys.groupBy("key").agg(F.min(F.struct("place", "slot")).alias("first"))
        order = [row["key"] for row in first.orderBy("first").collect()]
        schema = T.StructType([_plain(inferred[name]) for name in order])
    parsed = records.select(F.from_json("record", schema).alias("r"), place.alias(ORDER_COLUMN))
    names = parsed.schema["r"].dataType.fieldNames()
    return parsed.select(*[F.col("r." + quoted(n)).alias(n) for n in names], ORDER_COLUMN)


def _plain(field: T.StructField) -> T.StructField:
    """A variant's number types as the usual ones: decimals become doubles."""
    decimal = isinstance(field.dataType, T.DecimalType)
    return T.StructField(field.name, T.DoubleType() if decimal else field.dataType)


def _dump(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yaml = _yaml()
    dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
    for batch in batches:
        texts = [
            yaml.dump(
                [json.loads(text)], Dumper=dumper, default_flow_style=False, allow_unicode=True
            )
            for text in batch["record"]
        ]
        yield pd.DataFrame({"value": [text.rstrip("\n") for text in texts]})


def yaml_lines(df: DataFrame) -> DataFrame:
    """Each row as an item of a YAML sequence. Sequences concatenate, so every output file is a
    document by itself."""
    record = F.to_json(F.struct(*[quoted(n) for n in df.columns]), {"ignoreNullFields": "false"})
    return df.select(record.alias("record")).mapInPandas(_dump, "value string")

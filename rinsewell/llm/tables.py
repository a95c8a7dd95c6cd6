"""Reading the given tables, keeping intermediate tables, and naming columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinsewell.functions.names import col
from rinsewell.sources.scratch import scratch_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


FILE_BYTES = 128 << 20
GROUP_BYTES = 16 << 20  # of rows that a writer holds, and a reader takes, at once


def files_for(source: DataFrame) -> int:
    """How many tasks should write what is made from ``source``: one per 128 MB of it, one per core at least;
    10,000 if its size is not known.

    Many more would leave small files, each of which costs its reader as much as a large one.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 62 else 10_000 * FILE_BYTES
    return max(source.sparkSession.sparkContext.defaultParallelism, known // FILE_BYTES)


#: Has Spark drop the files of a query's exchanges as soon as the query ends.
_DROP_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, files: int | None = None, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: later plans start here, whatever is lost. What was
    exchanged to make it is dropped.

    ``files``: the most tasks to write it; they take over the partitions, in order. ``by``: a column whose values get
    folders of their own, so that rows of one can be read, and dropped, without those of the others.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    before = spark.conf.get(_DROP_EXCHANGES)
    spark.conf.set(_DROP_EXCHANGES, "true")
    try:
        out = (df.coalesce(files) if files else df).write.options(**{"compression": "zstd", "parquet.block.size": str(GROUP_BYTES)})
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(_DROP_EXCHANGES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._rinsewell_folder = path
    return table


def keep_dealt(df: DataFrame, by: str, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``keep``, with the rows in buckets by the column ``by``: what meets the table by that column comes to it, however often,
    and the table itself is not exchanged again. ``then``: what is made of the rows once they are dealt; it leaves them in place."""
    spark = df.sparkSession
    path, name = scratch_folder(spark), f"rinsewell_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(_DROP_EXCHANGES)
    spark.conf.set(_DROP_EXCHANGES, "true")
    try:
        out = then(df.repartition(buckets, by)).write.options(**{"compression": "zstd", "parquet.block.size": str(GROUP_BYTES)})
        out.bucketBy(buckets, by).option("path", path).saveAsTable(name, format="parquet")
    finally:
        spark.conf.set(_DROP_EXCHANGES, before)
    table = spark.table(name)
    table._rinsewell_folder, table._rinsewell_name = path, name
    return table


def drop(*tables: DataFrame, only: str = "") -> None:
    """Deletes tables that ``keep`` returned, once what was made from them is kept itself; ``only``: the folder of one value."""
    for table in tables:
        if hasattr(table, "_rinsewell_name"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._rinsewell_name}")
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{table._rinsewell_folder}/{only}".rstrip("/"))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The columns named on the right, under the names on the left, whatever else ``df`` has."""
    return df.select(*(col(source).alias(name) for name, source in columns.items()))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add."""
    taken = {name.lower() for name in names}
    return df.select(*(col(name) for name in df.columns if name.lower() not in taken))


def text_key(column) -> F.Column:
    """Sixteen bytes that stand for a text: rows of one text get one result, so repeated ids are no trouble."""
    return F.unhex(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")))

"""Reports as tables: one row per run, and sums over many runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

REPORT_SCHEMA = (
    "rows_loaded long, rows_output long, duplicates_removed long, rows_dropped long, "
    "modules_executed array<string>, processing_time_seconds double, "
    "module_stats map<string, map<string, string>>, output_path string, report_path string"
)


def report_row(spark: SparkSession, report: dict) -> DataFrame:
    """A report as one row, with the number of rows removed."""
    text = {key: value for key, value in report.items() if key != "steps"}
    parsed = spark.range(1).select(F.from_json(F.lit(json.dumps(text)), REPORT_SCHEMA).alias("r"))
    removed = (F.col("rows_loaded") - F.col("rows_output")).alias("rows_removed")
    return parsed.select("r.*").select("*", removed)


def write_report(spark: SparkSession, report: dict, path: str, mode: str = "append") -> None:
    """Add the report to a folder of JSON lines."""
    report_row(spark, {**report, "report_path": path}).write.mode(mode).json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of many runs: a folder written by ``write_report``, or folders of such folders."""
    return spark.read.option("recursiveFileLookup", True).schema(REPORT_SCHEMA).json(path)


def run_totals(reports: DataFrame) -> DataFrame:
    """How many tables were cleaned, and how many rows came out."""
    return reports.agg(
        F.count("*").alias("files_cleaned"),
        F.coalesce(F.sum("rows_output"), F.lit(0)).alias("rows_processed"),
    )


def totals_stream(spark: SparkSession, reports: str, out: str, checkpoint: str) -> StreamingQuery:
    """Bring the totals of a growing folder of reports up to date: reads every report once, whenever it came.

    The sums are the state of a stream; each run reads the new reports, adds them up and writes a version of all totals
    to ``<out>/version=<n>``, over again if a run was cut short. ``read_totals`` reads the latest.
    """
    rows = spark.readStream.option("recursiveFileLookup", True).schema(REPORT_SCHEMA).json(reports)
    steps = F.transform(F.map_entries("module_stats"), lambda s: F.transform(F.map_entries(s["value"]), lambda c: _cell(s["key"], c["key"], c["value"].try_cast("long"))))
    whole = F.array(_cell(F.lit(""), F.lit("files_cleaned"), F.lit(1)), _cell(F.lit(""), F.lit("rows_processed"), F.coalesce("rows_output", F.lit(0))))
    cells = rows.select(F.inline(F.concat(whole, F.coalesce(F.flatten(steps), F.array().cast("array<struct<step:string,metric:string,value:bigint>>")))))
    sums = cells.filter(F.col("value").isNotNull()).groupBy("step", "metric").agg(F.count("*").alias("runs"), F.sum("value").alias("total"))

    def write(totals: DataFrame, version: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{out}/version={version}")  # a row per step and metric

    return sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _cell(step: Column, metric: Column, value: Column) -> Column:
    return F.struct(step.alias("step"), metric.alias("metric"), value.cast("long").alias("value"))


def read_totals(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """``run_totals`` and ``module_totals`` as of the latest version that ``totals_stream`` wrote."""
    versions = spark.read.parquet(out)
    latest = versions.filter(F.col("version") == versions.agg(F.max("version")).first()[0]).drop("version")
    names = ["files_cleaned", "rows_processed"]
    runs = latest.filter("step = ''").agg(*[F.coalesce(F.max(F.when(F.col("metric") == n, F.col("total"))), F.lit(0)).alias(n) for n in names])
    return runs, latest.filter("step <> ''")


def module_totals(reports: DataFrame) -> DataFrame:
    """Each numeric metric of each step, summed over runs."""
    steps = reports.select(F.explode("module_stats").alias("step", "stats"))
    cells = steps.select("step", F.explode("stats").alias("metric", "text"))
    numbers = cells.select("step", "metric", F.col("text").try_cast("long").alias("value"))
    return (
        numbers.filter(F.col("value").isNotNull())
        .groupBy("step", "metric")
        .agg(F.count("*").alias("runs"), F.sum("value").alias("total"))
    )

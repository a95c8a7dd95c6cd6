"""From input path to cleaned table and report."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from ..sources import format_of, read_table
from .chunked import clean_chunks
from .clean import STEP, clean, with_overrides
from .report import write_report


def stem(path: str) -> str:
    """The name of a file or folder without its extension."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def clean_file(
    spark: SparkSession,
    path: str,
    out: str,
    steps: Iterable[STEP],
    format: str | None = None,
    output_format: str | None = None,
    chunk_size: int | None = None,
    report: bool = True,
    read: dict | None = None,
) -> dict:
    """Clean one input. The result goes to ``<out>/<name>_cleaned`` in ``output_format`` (that of
    the input), and the report, as one JSON line, to ``<out>/<name>_report``; ``report=False`` counts
    nothing. With ``chunk_size`` a CSV table is typed and cleaned chunk by chunk."""
    kind = format or format_of(path)
    read = dict(read or {})
    chunked = bool(chunk_size) and kind == "csv"
    infer = chunked and read.get("types", True)
    table = read_table(spark, path, format, **(read | {"types": False} if infer else read))
    if chunked:
        result = clean_chunks(table, list(steps), chunk_size, infer=infer)
    else:
        result = clean(table, steps)
    name = f"{out.rstrip('/')}/{stem(path)}"
    summary = result.write(f"{name}_cleaned", output_format or kind, report=report, mode="overwrite")
    if report:
        summary["report_path"] = f"{name}_report"
        write_report(spark, summary, summary["report_path"])
    return summary


def clean_files(spark: SparkSession, jobs: Iterable[dict], parallel: int = 1, **overrides) -> list[dict]:
    """Clean several inputs; each job holds the arguments of ``clean_file``.

    ``overrides`` are merged into every job. ``parallel`` inputs are worked off side by side, on the cores that one
    alone leaves idle; the reports come in the order of the jobs. The first error ends the run: jobs of Spark that
    still run are cancelled, no other input is begun, and outputs that are finished stay.
    """
    inputs = [with_overrides(job, overrides) for job in jobs]
    if parallel < 2:
        return [clean_file(spark, **job) for job in inputs]
    tag, ended = f"rinsewell-{uuid.uuid4().hex}", threading.Event()

    def one(job: dict) -> dict | None:
        if ended.is_set():
            return None
        spark.sparkContext.addJobTag(tag)
        try:
            return clean_file(spark, **job)
        except BaseException:
            ended.set()
            raise
        finally:
            spark.sparkContext.removeJobTag(tag)

    with ThreadPoolExecutor(parallel) as pool:
        # Each thread of Python has a thread of Spark's own, with the settings of this one.
        runs = [pool.submit(inheritable_thread_target(spark)(one), job) for job in inputs]
        _, running = wait(runs, return_when=FIRST_EXCEPTION)
        while running and ended.is_set():
            spark.sparkContext.cancelJobsWithTag(tag)  # again, as a thread may be between two jobs
            _, running = wait(running, timeout=0.2)
    failed = [run.exception() for run in runs if run.exception() is not None]
    if failed:
        # The cancelled ones failed too, but are not the reason.
        raise next((error for error in failed if "CANCEL" not in str(error).upper()), failed[0])
    return [run.result() for run in runs]

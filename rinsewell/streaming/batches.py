"""Structured Streaming: what needs no other row, and first rows by key, on the stream itself; all else by batch."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import col
from ..operators.base import Decisions, NeedsRows
from ..plans.clean import STEP, clean, read_spec
from ..plans.report import write_report
from ..sources import write_table

DEDUPE = "dedupe.drop_duplicates"


def is_stateless(df: DataFrame, steps: Iterable[STEP]) -> bool:
    """Whether each row of a table like ``df`` can be cleaned without looking at any other. The plan itself tells: it
    is made without rows to look at."""
    steps = list(steps)
    if any(step_id == DEDUPE for step_id, _ in filter(None, map(read_spec, steps))):
        return False
    try:
        clean(df, steps, decisions=Decisions(forbidden=True))
    except NeedsRows:
        return False
    return True


def first_rows(
    stream: DataFrame,
    subset: list[str] | None = None,
    order_by: str | list[str] | None = None,
    within: tuple[str, str] | None = None,
) -> DataFrame:
    """The stream without rows that repeat an earlier one, in whatever batch that came.

    Without ``subset`` whole rows are compared, and Spark's own state holds one key per distinct row. With
    ``subset`` the row of the earliest batch stays, and of one batch the first by ``order_by``; the state holds the first
    row of each key. Such a stream is written in output mode ``update``: each first row comes once, with its batch.
    ``within`` = (time column, how late rows may be, as ``"2 hours"``) bounds the state: rows are compared over that
    time only, of equal ones any may stay.
    """
    names = stream.columns
    if within is not None:
        return stream.withWatermark(*within).dropDuplicatesWithinWatermark(subset or names)
    keys = [name for name in names if name in subset] if subset else names
    rest = [name for name in names if name not in keys]
    if not rest:
        return stream.dropDuplicates()
    by = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not by:
        raise ValueError("duplicates on a subset of a stream go by order: name order_by columns")
    # The time of the batch leads, so that no later row takes the place of one that was handed on; a key whose
    # first row came in this very batch is new. A batch that is repeated has its old time again.
    order = [F.col("__now"), *[col(n).alias(f"by_{i}") for i, n in enumerate(by)]]
    first = F.min(F.struct(*order, F.struct(*map(col, rest)).alias("row"))).alias("__first")
    found = stream.withColumn("__now", F.current_timestamp()).groupBy(*map(col, keys)).agg(first)
    found = found.filter(F.col("__first.__now") == F.current_timestamp())
    return found.select(*[F.col("__first.row").getField(n).alias(n) if n in rest else col(n) for n in names])


def _on_the_stream(stream: DataFrame, steps: list[STEP], order_by, within) -> tuple[DataFrame, list[STEP], str]:
    """The stream after as many leading steps as are possible on it, the other steps, and the output mode that its
    state asks for, if it has any."""
    row_wise: list[STEP] = []
    mode = ""

    def cleaned() -> DataFrame:
        return clean(stream, row_wise).df if row_wise else stream

    for i, step in enumerate(steps):
        spec = read_spec(step)
        if spec is not None and spec[0] == DEDUPE:
            subset, keep = spec[1].get("subset"), spec[1].get("keep", "first")
            whole = subset is None or not set(stream.columns) - set(subset)
            if mode or not (keep == "first" or (whole and keep == "last")):
                return cleaned(), steps[i:], mode
            stream = first_rows(cleaned(), subset, order_by, within)
            mode, row_wise = "append" if whole or within else "update", []
        elif is_stateless(stream, [*row_wise, step]):
            row_wise.append(step)
        else:
            return cleaned(), steps[i:], mode
    return cleaned(), [], mode


def clean_stream(
    stream: DataFrame,
    steps: Iterable[STEP],
    order_by: str | list[str] | None = None,
    within: tuple[str, str] | None = None,
) -> DataFrame:
    """The cleaned stream.

    Possible here are steps that look at one row at a time, and duplicates of which the first stays (see
    ``first_rows`` for ``order_by``, ``within`` and the output mode): they go across all batches.
    """
    cleaned, left, _ = _on_the_stream(stream, list(steps), order_by, within)
    if left:
        raise ValueError(f"steps that compare rows need clean_stream_batches: {left[0]!r}")
    return cleaned


class DecisionLog:
    """What steps found out by looking at the rows of a stream so far, version by version.

    A version is written once per batch that found out anything new, before the rows of the batch are. A batch that is
    repeated finds its own version and decides the same; any other starts from the last version before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def of(self, batch: int) -> Decisions:
        found = self._versions().filter(F.col("batch") <= batch).orderBy(F.desc("batch")).first()
        if found is None:
            return Decisions()
        return Decisions(json.loads(found["known"]), settled=found["batch"] == batch)

    def write(self, batch: int, decisions: Decisions) -> None:
        known = json.dumps(decisions.known, sort_keys=True)
        last = self._versions().filter(F.col("batch") <= batch).orderBy(F.desc("batch")).first()
        if last is None or (last["batch"] < batch and last["known"] != known):
            row = self._spark.range(1).select(F.lit(known).alias("known"))
            row.write.mode("overwrite").parquet(f"{self._path}/batch={batch}")

    def _versions(self) -> DataFrame:
        try:
            found = self._spark.read.schema("known string, batch long").option("basePath", self._path).parquet(f"{self._path}/batch=*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], "known string, batch long")
        return found


def clean_stream_batches(
    stream: DataFrame,
    steps: Iterable[STEP],
    out: str,
    checkpoint: str,
    reports: str | None = None,
    format: str = "parquet",
    order_by: str | list[str] | None = None,
    trigger: dict | None = None,
    across_batches: bool = False,
    within: tuple[str, str] | None = None,
) -> StreamingQuery:
    """Clean each micro-batch and write it to ``<out>/batch=<n>``.

    A batch is a table of its own, or with ``across_batches`` a part of one table: duplicates go whatever batch they
    come in (where the first stays, and no step before looks at all rows), and what a step finds out by looking at rows (the
    layout of dates, the type of numbers, columns without values) holds from then on. It is kept in a log beside the
    checkpoint: layouts stay as found, types and the columns with values can only grow. A step that needs all batches
    at once is an error then.

    A batch that is repeated after a failure decides as before and overwrites its own folders, so no row and no report
    is kept twice. Reports count the steps that run by batch.
    """
    steps, mode, log = list(steps), "", None
    if across_batches:
        stream, steps, mode = _on_the_stream(stream, steps, order_by, within)
        late = [step for step in steps if (read_spec(step) or ("",))[0] == DEDUPE]
        if late:
            raise ValueError(f"duplicates of all batches cannot go here: {late[0]!r}")
        log = DecisionLog(stream.sparkSession, f"{checkpoint.rstrip('/')}-decisions")

    def run(batch: DataFrame, number: int) -> None:
        if mode:
            batch.persist()  # the state is asked once, however often steps look at the rows
        decisions = log.of(number) if log else Decisions()
        result = clean(batch, steps, order_by, decisions=decisions)
        if log:
            log.write(number, decisions)
        report = result.write(f"{out}/batch={number}", format, mode="overwrite")
        if reports:
            write_report(batch.sparkSession, report, f"{reports}/batch={number}", mode="overwrite")
        if mode:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(run)
        .outputMode(mode or "append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

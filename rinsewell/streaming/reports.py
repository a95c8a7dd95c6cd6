"""Reports of streams whose rows are cleaned one at a time: counters that Spark observes in every batch."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.base import Decisions
from ..plans.clean import STEP, CleanResult, clean
from ..plans.report import write_report


class StreamReport(StreamingQueryListener):
    """Writes the report of each batch to ``<path>/batch=<n>``, once, when Spark announces the batch as done.

    The counters travel with the rows and are summed by the batch that carries them out; no second pass counts. A
    batch that is repeated after a restart overwrites its report. Batches without rows have none. Register with
    ``spark.streams.addListener`` before the query starts; ``wait`` returns when the query has ended and its last report is
    written, and raises what went wrong in writing.
    """

    def __init__(self, result: CleanResult, name: str, path: str, spark: SparkSession):
        self._result, self._name, self._path, self._spark = result, name, path.rstrip("/"), spark
        self._run: str | None = None
        self._ended, self._error = threading.Event(), None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counters = event.progress.observedMetrics.get(self._name)
        if counters is None:
            return
        self._run = str(event.progress.runId)
        measured = counters.asDict()
        if not measured.get("__n_loaded"):
            return
        try:
            report = self._result.report_of(measured)
            write_report(self._spark, report, f"{self._path}/batch={event.progress.batchId}", mode="overwrite")
        except Exception as error:  # a listener has nobody to raise to
            self._error = error

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._run is None or str(event.runId) == self._run:
            self._ended.set()

    def wait(self, seconds: float | None = None) -> None:
        if not self._ended.wait(seconds):
            raise TimeoutError("the stream has not ended")
        if self._error is not None:
            raise self._error


def reported_stream(stream: DataFrame, steps: Iterable[STEP], path: str) -> tuple[DataFrame, StreamReport]:
    """The cleaned stream, for any sink, and the listener that writes a report per batch. Only steps that look at one
    row at a time are possible here."""
    result = clean(stream, list(steps), decisions=Decisions(forbidden=True))
    name = f"rinsewell-{uuid.uuid4().hex}"
    rows, _ = result.counted(name)
    return rows, StreamReport(result, name, path, stream.sparkSession)

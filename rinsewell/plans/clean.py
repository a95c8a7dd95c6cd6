"""Running a list of steps over a table."""

from __future__ import annotations

import time
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import col
from ..operators import Plan, find_step
from ..operators.base import Decisions
from ..sources.order import ORDER_COLUMN
from .frame import ORDER, Frame

STEP = str | dict
CHUNK_COLUMN = "__row_number"


def read_spec(spec: STEP) -> tuple[str, dict] | None:
    """Step id and options of ``"group.name"`` or ``{"id": ..., "options": {...}}``."""
    if isinstance(spec, str):
        return spec, {}
    if isinstance(spec, dict) and "id" in spec:
        return spec["id"], spec.get("options") or {}
    warnings.warn(f"skipping invalid step {spec!r}: need an id or a dict with 'id'", stacklevel=3)
    return None


def with_overrides(options: dict, overrides: dict) -> dict:
    """Options with overrides merged one level deep: dictionaries join, other values replace."""
    merged = dict(options)
    for key, value in overrides.items():
        both = isinstance(value, dict) and isinstance(merged.get(key), dict)
        merged[key] = {**merged[key], **value} if both else value
    return merged


@dataclass
class Entry:
    """One executed step in the report."""

    step: str
    stats: dict
    segment: int
    removed_as: str = ""


@dataclass
class Segment:
    """Steps between two steps of the user's own: the same plans, applied without and with counters."""

    source: DataFrame
    names: list[str]
    order: Column | None
    scope: list[Column]
    plans: list[tuple[int, Plan, bool]] = field(default_factory=list)

    def __post_init__(self):
        self.plain = self._start(counted=False)

    def _start(self, counted: bool) -> Frame:
        return Frame.start(self.source, self.names, self.order, self.scope, counted)

    def add(self, position: int, plan: Plan, ordered: bool) -> None:
        """``ordered``: whether this step or a later one needs the order of rows."""
        self.plans.append((position, plan, ordered))
        self.plain = self._apply(self.plain, position, plan, ordered)

    def _apply(self, frame: Frame, position: int, plan: Plan, ordered: bool) -> Frame:
        return (frame if ordered else frame.unordered()).apply(plan, position)

    @cached_property
    def counted(self) -> Frame:
        frame = self._start(counted=True)
        for step in self.plans:
            frame = self._apply(frame, *step)
        return frame


class CleanResult:
    """The cleaned table and its metrics.

    ``df`` is lazy and counts nothing. ``write()`` writes it and counts in the same pass.
    ``totals()`` is a one-row (or one row per scope) DataFrame of raw counters, ``report()`` the
    finished report; after ``write()`` it costs no further job.
    """

    def __init__(self, segments: list[Segment], entries: list[Entry], scope: list[str], started: float):
        self._segments = segments
        self._entries = entries
        self._scope = scope
        self._started = started
        self._measured: dict[int, dict] = {}
        self.df = segments[-1].plain.result()

    def counted(self, watch: Observation | str | None = None) -> tuple[DataFrame, Observation | str]:
        """The cleaned table again, with an observation that one complete action fills; on a stream it is a name,
        and every batch fills it."""
        last, watch = self._segments[-1].counted, watch or Observation()
        return last.result(last.rows.observe(watch, *last.sums())), watch

    def totals(self, segment: int = -1) -> DataFrame:
        """Counters summed over all rows, by scope where the run has one."""
        frame = self._segments[segment].counted
        if not frame.scope:
            return frame.rows.agg(*frame.sums())
        named = [F.col(hidden).alias(name) for hidden, name in zip(frame.scope, self._scope)]
        return frame.rows.groupBy(*named).agg(*frame.sums())

    def metrics(self) -> DataFrame:
        """All counters in long form: scope columns, position, step, metric, value."""
        parts = []
        for segment, frame in enumerate(s.counted for s in self._segments):
            wanted = [
                (i, entry.step, counter)
                for i, entry in enumerate(self._entries)
                for counter in frame.counters
                if counter.startswith(f"__n_{i}_")
            ]
            cells = [
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(name).alias("step"),
                    F.lit(counter.split("_", 4)[4]).alias("metric"),
                    F.col(counter).alias("value"),
                )
                for i, name, counter in wanted
            ]
            if cells:
                totals = self.totals(segment)
                scope = [F.col(name) for name in self._scope]
                parts.append(totals.select(*scope, F.inline(F.array(*cells))))
        if not parts:
            raise ValueError("no step of this run counts anything")
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def write(self, path: str, format: str | None = None, report: bool = True, **options) -> dict:
        """Write the cleaned rows, and return the report measured in the same pass.

        ``report=False`` writes the plain table, counts nothing and returns the path alone.
        """
        from ..sources import write_table

        if not report:
            write_table(self.df, path, format, **options)
            return {"output_path": path}
        rows, watch = self.counted()
        write_table(rows, path, format, **options)
        self._measured[len(self._segments) - 1] = dict(watch.get)
        return {**self.report(), "output_path": path}

    def report(self) -> dict:
        """The report of the whole run, over all scopes."""
        return self._report(self._measured)

    def report_of(self, counters: dict) -> dict:
        """The report of a part of the table, from the counters observed on it (see ``counted``)."""
        if len(self._segments) > 1:
            raise ValueError("counters of runs with steps of your own are measured segment by segment")
        return self._report({0: counters})

    def _report(self, measured: dict[int, dict]) -> dict:
        """The report from counters by segment; those that are missing are measured."""
        for segment, frame in enumerate(s.counted for s in self._segments):
            if segment not in measured:
                measured[segment] = frame.rows.agg(*frame.sums()).first().asDict()
        counts = {name: value or 0 for part in measured.values() for name, value in part.items()}
        loaded = [measured[i]["__n_loaded"] or 0 for i in range(len(measured))]
        output = [measured[i]["__n_output"] or 0 for i in range(len(measured))]
        steps, dropped, duplicates = [], 0, 0
        for i, entry in enumerate(self._entries):
            stats = dict(entry.stats)
            if not stats and not entry.removed_as:
                stats = {"rows_before": output[entry.segment - 1], "rows_after": loaded[entry.segment]}
            for name, value in counts.items():
                if name.startswith(f"__n_{i}_"):
                    stats[name.split("_", 4)[4]] = value
            removed = stats.get(entry.removed_as, 0)
            if entry.removed_as == "duplicates_removed":
                duplicates += removed
            elif entry.removed_as:
                dropped += removed
            steps.append({"step": entry.step, "stats": stats})
        return {
            "rows_loaded": loaded[0],
            "rows_output": output[-1],
            "duplicates_removed": duplicates,
            "rows_dropped": dropped,
            "modules_executed": [entry["step"] for entry in steps],
            "processing_time_seconds": round(time.perf_counter() - self._started, 4),
            "module_stats": {entry["step"]: entry["stats"] for entry in steps},
            "steps": steps,
        }


def _needs_order(specs: list[tuple[str, dict]]) -> bool:
    for step_id, options in specs:
        if step_id == "dedupe.drop_duplicates":
            if options.get("subset") is not None and options.get("keep", "first") is not False:
                return True
        if step_id == "validation.coerce_datetime" and not options.get("format"):
            return True
    return False


def clean(
    df: DataFrame,
    steps: Iterable[STEP],
    order_by: str | list[str] | None = None,
    scope: str | dict[str, Column] | list[str] | None = None,
    decisions: Decisions | None = None,
) -> CleanResult:
    """Apply the steps in order.

    ``order_by`` names the columns that define first and last; tables from ``read_table`` bring
    their own order. ``scope`` names columns (or gives named expressions) whose groups are cleaned
    as separate tables: duplicates, empty columns and reports are per group. ``decisions`` hold what steps find
    out by looking at rows, and what they found on earlier tables.
    """
    decisions = decisions if decisions is not None else Decisions()
    started = time.perf_counter()
    specs = [spec for spec in map(read_spec, steps) if spec is not None]
    if isinstance(scope, str):
        scope = [scope]
    if not isinstance(scope, dict):
        scope = {name: col(name) for name in scope or []}
    names = [name for name in df.columns if name not in (ORDER_COLUMN, CHUNK_COLUMN)]
    order = None
    if _needs_order(specs):
        by = [order_by] if isinstance(order_by, str) else order_by
        if by:
            order = F.struct(*map(col, by))
        elif ORDER_COLUMN in df.columns:
            order = F.col(ORDER_COLUMN)
    segments, entries = [Segment(df, names, order, list(scope.values()))], []
    for position, (step_id, options) in enumerate(specs):
        segment = segments[-1]
        plan = find_step(step_id)(segment.plain.table(decisions, f"{position}:{step_id}"), options)
        if plan.custom is None:
            segment.add(position, plan, _needs_order(specs[position:]))
            entries.append(Entry(step_id, plan.stats, len(segments) - 1, plan.removed_as))
            continue
        frame = segment.plain
        ordered = frame.ordered and _needs_order(specs[position + 1 :])
        hidden = [*frame.scope, *([ORDER] if ordered else [])]
        after, stats = _call(plan.custom, frame.result(hidden=hidden), options)
        lost = [name for name in hidden if name not in after.columns]
        if lost:
            raise ValueError(f"{step_id}: the step dropped {lost}, which keep order or scope for later steps")
        names = [name for name in after.columns if name not in hidden]
        segments.append(Segment(after, names, F.col(ORDER) if ordered else None, [F.col(s) for s in frame.scope]))
        entries.append(Entry(step_id, stats, len(segments) - 1))
    return CleanResult(segments, entries, list(scope), started)


def _call(function, df: DataFrame, options: dict) -> tuple[DataFrame, dict]:
    answer = function(df, options)
    return answer if isinstance(answer, tuple) else (answer, {})

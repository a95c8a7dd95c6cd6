"""What a step is, and the register of steps by id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import col, is_text


class NeedsRows(Exception):
    """A step has to look at rows where there are none to look at, as on a stream."""


@dataclass
class Decisions:
    """What steps found out by looking at rows, by step and question.

    A plan asks here and nowhere else, so that it is known which steps look at rows, and that findings can outlast
    the table they were made on: those of earlier tables (the batches of a stream) are merged with those of
    this one. All findings are plain JSON values.
    """

    known: dict[str, object] = field(default_factory=dict)
    settled: bool = False  # the findings are those of this very table: nobody looks again
    forbidden: bool = False  # looking is an error

    def find(self, key: str, look: Callable[[], object], merge: Callable[[object, object], object]) -> object:
        if self.forbidden:
            raise NeedsRows(key)
        if self.settled and key in self.known:
            return self.known[key]
        found = look()
        self.known[key] = merge(self.known[key], found) if key in self.known else found
        return self.known[key]


def merge_lists(old: list, new: list) -> list:
    return sorted({*old, *new})


@dataclass(frozen=True)
class Table:
    """The table a step is planned against: its visible columns and the rows so far.

    ``rows`` also carries hidden columns (see ``plans.frame``). A step looks at ``rows`` only when
    its result depends on data, such as which columns are empty.
    """

    rows: DataFrame
    names: list[str]
    order: Column | None = None
    scope: list[str] = field(default_factory=list)
    shuffled: bool = False  # the first rows cost as much as all rows
    decisions: Decisions = field(default_factory=Decisions)
    step: str = ""  # names the step among the decisions

    def find(self, question: str, look: Callable[[], object], merge: Callable[[object, object], object]) -> object:
        """The answer to a question about all rows, in plain JSON values; ``merge`` joins those of several tables."""
        return self.decisions.find(f"{self.step}/{question}", look, merge)

    def types(self) -> dict[str, T.DataType]:
        schema = self.rows.schema
        return {name: schema[name].dataType for name in self.names}

    def present(self, wanted) -> list[str]:
        """The wanted names that exist, in the given order."""
        return [name for name in wanted or [] if name in self.names]

    def text_columns(self, wanted=None) -> list[str]:
        """The wanted columns, by default every string column."""
        if wanted is not None:
            return self.present(wanted)
        return [name for name, dtype in self.types().items() if is_text(dtype)]


@dataclass(frozen=True)
class Change:
    """A new value for one column.

    The ``work`` is computed once per row; ``value`` and ``counts`` are derived from the old cell
    and from it, so counting changes does not repeat the work. Several results of work are several
    columns, not one struct: the optimizer takes structs apart and would compute each use anew.
    ``keeps_null``: the new cell is null exactly where the old one is.
    """

    name: str
    work: list[Column]
    value: Callable[..., Column] = lambda old, work: work
    counts: Callable[..., dict[str, Column]] = lambda old, *work: {}
    keeps_null: bool = False
    dates: bool = False  # the new cells are timestamps without a time of day


#: Metadata of columns whose timestamps have no time of day by construction.
DATES = {"rinsewell.dates": True}


@dataclass(frozen=True)
class Filter:
    """Rows go that are null in any, or in all, of the columns."""

    columns: list[str]
    how: str


@dataclass(frozen=True)
class Dedupe:
    subset: list[str] | None
    keep: str | bool


@dataclass(frozen=True)
class Plan:
    """The effect of one step. At most one of the groups below is set.

    ``stats`` holds what is known from the schema. The metrics that need data are sums over rows:
    those of ``changes``, or the number of rows that ``keep`` or ``dedupe`` takes away.
    """

    stats: dict = field(default_factory=dict)
    changes: list[Change] = field(default_factory=list)
    columns: list[tuple[str, str]] | None = None  # (name now, name after)
    keep: Filter | None = None
    raises: bool = False  # the changes may end the run, so no later filter may come before them
    dedupe: Dedupe | None = None
    removed_as: str = ""
    emptied: DataFrame | None = None  # per scope: which columns to blank out
    lookup: DataFrame | None = None  # per scope: hidden columns that the changes refer to
    custom: Callable[[DataFrame, dict], DataFrame] | None = None


Planner = Callable[[Table, dict], Plan]
_STEPS: dict[str, Planner] = {}


def planner(step_id: str):
    """Register a built-in step."""

    def add(function: Planner) -> Planner:
        _STEPS[step_id] = function
        return function

    return add


def step(step_id: str):
    """Register a step of your own: ``function(df, options) -> DataFrame``.

    Use DataFrame operations, or ``pandas_udf`` / ``mapInPandas`` where per-row Python is needed.
    The function gets the visible columns. Where the run has a scope, or a later step needs the order of
    rows, it also gets hidden columns (``__scope_0``, ``__order``) and must hand them on: ``withColumn``,
    ``filter`` and joins do, a ``select`` has to name them. Its report entry holds the row counts around it;
    a function that returns ``(DataFrame, dict)`` reports that dictionary instead.
    """
    if "." not in step_id:
        raise ValueError(f"step id must be 'group.name': {step_id!r}")

    def add(function):
        _STEPS[step_id] = lambda table, options: Plan(custom=function)
        return function

    return add


def find_step(step_id: str) -> Planner:
    if "." not in step_id:
        raise ValueError(f"step id must be 'group.name': {step_id!r}")
    if step_id not in _STEPS:
        raise KeyError(f"unknown step: {step_id!r}")
    return _STEPS[step_id]


def differs(old: Column, new: Column) -> Column:
    """1 where a cell that is not null has changed."""
    return F.when(old != new, 1).otherwise(0)


def when_set(old: Column, condition: Column) -> Column:
    """1 where the cell is not null and the condition holds."""
    return F.when(old.isNotNull() & condition, 1).otherwise(0)


def is_kept(names: list[str], how: str) -> Column:
    """Whether a row stays under a filter on nulls in any or all of the columns."""
    kept = F.lit(how == "any")
    for name in names:
        kept = kept & col(name).isNotNull() if how == "any" else kept | col(name).isNotNull()
    return kept

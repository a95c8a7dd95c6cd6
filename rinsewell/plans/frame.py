"""Rows on their way through a run.

With counting on, every row carries its own counters: how many of its cells each step changed, and
whether a step took it away. Rows that a filter removes stay on as blanks with ``__live`` false, and
a de-duplication adds the counters of the rows it merges. Summing the counters at the very end gives
the whole report in the same pass as the result. Because they travel as data, a task or stage that
is run again after losing an executor cannot count anything twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import col
from ..operators.base import DATES, Change, Decisions, Dedupe, Filter, Plan, Table, is_kept

LIVE, ORDER, LOADED = "__live", "__order", "__n_loaded"


@dataclass(frozen=True)
class Frame:
    rows: DataFrame
    names: list[str]  # visible columns
    shown: list[str]  # visible columns in output order, repeats included
    counted: bool
    ordered: bool
    scope: list[str] = field(default_factory=list)  # hidden columns: runs kept apart
    counters: list[str] = field(default_factory=list)
    shuffled: bool = False
    root: Frame | None = None  # the frame before the changes in ``history``, uncounted runs only
    history: list[tuple[int, Plan]] = field(default_factory=list)
    before: Frame | None = None  # the frame that the latest changes were made to
    latest: list[tuple[int, Change]] = field(default_factory=list)
    kept: dict[str, str] = field(default_factory=dict)  # column -> hidden "not blanked here" flag

    # -- making and ending ---------------------------------------------------------------------

    @staticmethod
    def start(
        df: DataFrame, names: list[str], order: Column | None, scope: list[Column], counted: bool
    ) -> Frame:
        hidden = [c.alias(f"__scope_{i}") for i, c in enumerate(scope)]
        if order is not None:
            hidden.append(order.alias(ORDER))
        if counted:
            hidden += [F.lit(True).alias(LIVE), F.lit(1).alias(LOADED)]
        floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
        # NaN means null, wherever a table comes from.
        cells = [F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floating else col(n) for n in names]
        return Frame(
            df.select(*cells, *hidden),
            names,
            names,
            counted,
            order is not None,
            [f"__scope_{i}" for i in range(len(scope))],
            [LOADED] if counted else [],
        )

    def table(self, decisions: Decisions, step: str) -> Table:
        order = F.col(ORDER) if self.ordered else None
        return Table(self.rows, self.names, order, self.scope, self.shuffled, decisions, step)

    def result(self, rows: DataFrame | None = None, hidden: list[str] | tuple = ()) -> DataFrame:
        """The visible columns of the rows that are left, and those hidden ones that are asked for."""
        rows = self.rows if rows is None else rows
        if self.counted:
            rows = rows.filter(LIVE)
        return rows.select(*map(col, [*self.shown, *hidden]))

    def unordered(self) -> Frame:
        """Without the order of rows, once no step needs it: de-duplication is cheaper then."""
        if not self.ordered:
            return self
        return replace(self, rows=self.rows.drop(ORDER), ordered=False, root=None, history=[], before=None, latest=[])

    def sums(self) -> list[Column]:
        """The counters as aggregates, plus the number of rows left."""
        sums = [F.sum(name).alias(name) for name in self.counters]
        return [*sums, F.count_if(F.col(LIVE)).alias("__n_output")]

    # -- steps ---------------------------------------------------------------------------------

    def apply(self, plan: Plan, position: int) -> Frame:
        if not plan.changes:
            return replace(self, before=None, latest=[])._other(plan, position)
        made = self._changed(plan, position)
        if self.counted or plan.raises or plan.lookup is not None:
            return replace(made, root=None, history=[])
        root = self.root or replace(self, before=None, latest=[])
        return replace(made, root=root, history=[*self.history, (position, plan)])

    def _changed(self, plan: Plan, position: int) -> Frame:
        changes = [(position, change) for change in plan.changes]
        if plan.lookup is not None:
            known = [name for name in plan.lookup.columns if name not in self.scope]
            found = replace(self, rows=self._join(plan.lookup))._change(changes)
            return replace(found, rows=found.rows.drop(*known), before=None, latest=[])
        touched = {change.name for _, change in self.latest}
        if self.before is not None and touched.isdisjoint(c.name for c in plan.changes):
            # Steps on different columns share one projection.
            return self.before._change([*self.latest, *changes])
        return self._change(changes)

    def _other(self, plan: Plan, position: int) -> Frame:
        counter = f"__n_{position}_{plan.removed_as}"
        if plan.keep is not None and not self.counted:
            return self._filter_early(plan.keep)
        fresh = replace(self, root=None, history=[])
        if plan.columns is not None:
            return fresh._choose(plan)
        if plan.keep is not None:
            return fresh._filter(plan.keep, counter)
        if plan.dedupe is not None:
            return fresh._dedupe(plan.dedupe, counter)
        return self

    def _filter_early(self, keep: Filter) -> Frame:
        """A filter on nulls goes before the changes that leave these nulls alone: then it reaches the
        scan, and no work is done on rows that go."""
        changes = [change for _, plan in self.history for change in plan.changes]
        touched = {c.name for c in changes if not c.keeps_null or c.name in self.kept}
        if self.root is None or not touched.isdisjoint(keep.columns):
            # Cells as they were given come first: they often decide without any work.
            columns = sorted(keep.columns, key=lambda name: name in {c.name for c in changes})
            rows = self.rows.filter(is_kept(columns, keep.how))
            return replace(self, rows=rows, root=None, history=[])
        rows = self.root.rows.filter(is_kept(keep.columns, keep.how))
        frame = replace(self.root, rows=rows, root=None, history=[])
        for position, plan in self.history:
            frame = frame.apply(plan, position)
        return frame

    def _hidden(self) -> list[str]:
        live = [LIVE] if self.counted else []
        order = [ORDER] if self.ordered else []
        return [*self.scope, *order, *live, *self.counters, *self.kept.values()]

    def _change(self, changes: list[tuple[int, Change]]) -> Frame:
        work = {
            f"__work_{i}_{j}": part
            for i, (_, change) in enumerate(changes)
            for j, part in enumerate(change.work)
        }
        rows = self.rows.withColumns(work) if work else self.rows
        new, counts = {}, {}
        for i, (position, change) in enumerate(changes):
            old = col(change.name)
            done = [F.col(f"__work_{i}_{j}") for j in range(len(change.work))]
            value = change.value(old, *done)
            if change.name in self.kept:
                value = F.when(F.col(self.kept[change.name]), value)
            new[change.name] = value.alias(change.name, metadata=DATES) if change.dates else value
            for metric, count in change.counts(old, *done).items() if self.counted else ():
                name = f"__n_{position}_{metric}"
                counts[name] = counts[name] + count if name in counts else count
        gated = {name: F.when(F.col(LIVE), n).otherwise(0) for name, n in counts.items()}
        rows = rows.withColumns({**new, **gated}).drop(*work)
        return replace(
            self,
            rows=rows,
            counters=[*self.counters, *counts],
            before=self,
            latest=changes,
        )

    def _choose(self, plan: Plan) -> Frame:
        frame = self
        if plan.emptied is not None:
            frame = frame._blank(plan.emptied)
        after = dict(plan.columns)
        shown = [after[name] for name in self.shown if name in after]
        if [now for now, _ in plan.columns] != [n for n in self.names if n in after]:
            shown = [after[name] for name, _ in plan.columns]
        names = list(dict.fromkeys(after.values()))
        kept = {after[name]: flag for name, flag in frame.kept.items() if name in after}
        frame = replace(frame, kept=kept)
        rows = frame.rows.select(
            *[col(now).alias(new) for now, new in after.items()], *map(col, frame._hidden())
        )
        return replace(frame, rows=rows, names=names, shown=shown)

    def _blank(self, emptied: DataFrame) -> Frame:
        """Null out the columns that are empty throughout a row's scope, and keep them so."""
        flags = {name[len("__kept_") :]: name for name in emptied.columns if name[:7] == "__kept_"}
        kept = {**self.kept, **flags}
        hidden = list(dict.fromkeys([*self._hidden(), *flags.values()]))
        repeated = [flag for flag in flags.values() if flag in self.kept.values()]
        rows = replace(self, rows=self.rows.drop(*repeated))._join(emptied).select(
            *[
                F.when(col(flags[name]), col(name)).alias(name) if name in flags else col(name)
                for name in self.names
            ],
            *[col(name) for name in hidden],
        )
        return replace(self, rows=rows, kept=kept)

    def _join(self, per_scope: DataFrame) -> DataFrame:
        """The rows with the columns of a table that has one row per scope."""
        keys = {name: f"__key_{i}" for i, name in enumerate(self.scope)}
        matching = F.lit(True)
        for name, key in keys.items():
            matching = matching & F.col(name).eqNullSafe(F.col(key))
        return self.rows.join(per_scope.withColumnsRenamed(keys), matching, "left").drop(*keys.values())

    def _filter(self, keep: Filter, counter: str) -> Frame:
        """Counted: rows that go stay on as blanks."""
        stays, lived = F.col("__stays"), F.col(LIVE)
        rows = self.rows.select("*", (lived & is_kept(keep.columns, keep.how)).alias("__stays"))
        hidden = [col(name) for name in self._hidden() if name != LIVE]
        rows = rows.select(
            *[F.when(stays, col(name)).alias(name) for name in self.names],
            *hidden,
            stays.alias(LIVE),
            (lived & ~stays).cast("int").alias(counter),
        )
        return replace(self, rows=rows, counters=[*self.counters, counter])

    def _dedupe(self, dedupe: Dedupe, counter: str) -> Frame:
        """One aggregation by key. Every task first merges its own rows, so that a key held by a
        third of the table costs the shuffle one row per task."""
        keys = dedupe.subset or self.names
        group = [*self.scope, *([LIVE] if self.counted else []), *dict.fromkeys(keys)]
        carried = [name for name in self.names if name not in keys] + list(self.kept.values())
        whole_row = not [name for name in self.names if name not in keys]
        if not whole_row and dedupe.keep and not self.ordered:
            raise ValueError("drop_duplicates on a subset keeps rows by order: name order_by columns")
        aggregates = [F.sum(name).alias(name) for name in self.counters]
        aggregates.append(F.count("*").alias("__size"))
        payload = ([ORDER] if self.ordered else []) + carried
        pick = F.max if dedupe.keep == "last" else F.min
        if payload:
            aggregates.append(pick(F.struct(*[col(name) for name in payload])).alias("__row"))
        merged = self.rows.groupBy(*[col(name) for name in group]).agg(*aggregates)
        unpacked = {name: F.col("__row").getField(name).alias(name) for name in payload}
        alone = F.col("__size") == 1
        visible = [unpacked.get(name, col(name)) for name in self.names]
        hidden = [unpacked.get(name, col(name)) for name in self._hidden() if name != LIVE]
        if not self.counted:
            rows = merged if dedupe.keep else merged.filter(alone)
            return replace(self, rows=rows.select(*visible, *hidden), shuffled=True)
        lived = F.col(LIVE)
        if dedupe.keep:
            stays, removed = lived, F.col("__size") - 1
        else:
            stays, removed = lived & alone, F.when(alone, 0).otherwise(F.col("__size"))
            visible = [
                F.when(stays, unpacked[name] if name in unpacked else col(name)).alias(name)
                for name in self.names
            ]
        rows = merged.select(
            *visible,
            *hidden,
            stays.alias(LIVE),
            F.when(lived, removed).otherwise(0).alias(counter),
        )
        return replace(self, rows=rows, counters=[*self.counters, counter], shuffled=True)

"""Steps that choose and name columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import col, is_blank, is_text
from ..sources.scratch import kept
from .base import Plan, Table, merge_lists, planner

FIRST_ROWS = 1_000


@planner("core.drop_columns")
def drop_columns(table: Table, options: dict) -> Plan:
    """``columns``: names to drop; names that do not exist are skipped."""
    dropped = table.present(options.get("columns"))
    if not dropped:
        return Plan({"columns_dropped": 0})
    return Plan(
        {"columns_dropped": len(dropped), "dropped_columns": dropped},
        columns=[(name, name) for name in table.names if name not in dropped],
    )


@planner("core.select_columns")
def select_columns(table: Table, options: dict) -> Plan:
    """``columns``: names to keep, in this order; ``strict``: a missing name is an error."""
    wanted = options.get("columns") or []
    if not wanted:
        return Plan({"columns_selected": 0})
    selected = table.present(wanted)
    if options.get("strict") and len(selected) < len(wanted):
        missing = [name for name in wanted if name not in table.names]
        raise KeyError(f"select_columns: missing columns {missing}")
    return Plan(
        {
            "columns_selected": len(selected),
            "columns_dropped": len(table.names) - len(selected),
            "selected": selected,
        },
        columns=[(name, name) for name in selected],
    )


@planner("core.rename_columns")
def rename_columns(table: Table, options: dict) -> Plan:
    """``mapping``: old name to new name, all at once, so two columns can swap names."""
    mapping = options.get("mapping") or {}
    renamed = {old: new for old, new in mapping.items() if old in table.names}
    if not renamed:
        return Plan({"renamed": []})
    after = [renamed.get(name, name) for name in table.names]
    if len(set(after)) < len(set(table.names)):
        raise ValueError(f"rename_columns: two columns would share a name: {after}")
    return Plan(
        {"renamed": [{"old": old, "new": new} for old, new in renamed.items()]},
        columns=list(zip(table.names, after)),
    )


def _filled(name: str, text: bool, blank_is_empty: bool) -> Column:
    filled = col(name).isNotNull()
    return filled & ~is_blank(col(name)) if text and blank_is_empty else filled


@planner("core.drop_empty_columns")
def drop_empty_columns(table: Table, options: dict) -> Plan:
    """``subset``: columns to check (all); ``treat_blank_strings_as_empty`` (true).

    Which columns go depends on the data. One value is proof that a column stays, and for most
    columns the first rows hold one; only columns without any there are then searched through all
    rows, reading nothing else. In a table without rows every checked column is empty.
    """
    subset = options.get("subset")
    checked = list(dict.fromkeys(table.names if subset is None else table.present(subset)))
    if not checked:
        return Plan({"columns_dropped": 0, "dropped_columns": []})
    blank_is_empty = options.get("treat_blank_strings_as_empty", True)
    types = table.types()
    filled = {name: _filled(name, is_text(types[name]), blank_is_empty) for name in checked}
    if table.scope:
        return _drop_by_scope(table, filled)

    def look() -> list[str]:
        unsure = list(filled)
        if not table.shuffled:
            first = table.rows.select(*[filled[name] for name in unsure]).take(FIRST_ROWS)
            unsure = [name for i, name in enumerate(unsure) if not any(row[i] for row in first)]
        empty = []
        if unsure:
            found = table.rows.agg(*[F.bool_or(filled[name]) for name in unsure]).first()
            empty = [name for name, any_value in zip(unsure, found) if not any_value]
        return [name for name in filled if name not in empty]

    held = table.find("columns with values", look, merge_lists)
    return _without(table, [name for name in filled if name not in held])


def _without(table: Table, dropped: list[str], emptied: DataFrame | None = None) -> Plan:
    return Plan(
        {"columns_dropped": len(dropped), "dropped_columns": dropped},
        columns=[(name, name) for name in table.names if name not in dropped],
        emptied=emptied,
    )


def _drop_by_scope(table: Table, filled: dict[str, Column]) -> Plan:
    """Drop the columns that no scope fills, and blank out the others where their scope does not.

    What each scope fills is found once and is a scratch table. Its size is known when the rows are planned, so they are
    not dealt out to meet a small one."""
    flags = {name: f"__kept_{name}" for name in filled}
    any_value = [F.coalesce(F.bool_or(f), F.lit(False)).alias(flags[n]) for n, f in filled.items()]
    per_scope = kept(table.rows.groupBy(*table.scope).agg(*any_value))
    overall = per_scope.agg(
        *[F.bool_or(col(flag)).alias(flag) for flag in flags.values()]
    ).first()
    dropped = [name for name, flag in flags.items() if not overall[flag]]
    emptied = per_scope.drop(*[flags[name] for name in dropped])
    return _without(table, dropped, emptied)

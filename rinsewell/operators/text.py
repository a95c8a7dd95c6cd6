"""Steps on text cells. Default columns are all string columns; nulls stay null."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .base import Change, Plan, Table, differs, planner


@planner("text.trim_whitespace")
def trim_whitespace(table: Table, options: dict) -> Plan:
    columns = table.text_columns(options.get("columns"))
    if not columns:
        return Plan({"columns_trimmed": 0})
    types = table.types()
    changes = [
        Change(
            name,
            [fn.strip(fn.col(name))],
            counts=lambda old, work: {"cells_changed": differs(old, work)},
            keeps_null=True,
        )
        for name in columns
        if fn.is_text(types[name])  # the text of any other type has no outer whitespace
    ]
    return Plan({"columns_trimmed": len(columns), "cells_changed": 0}, changes)


@planner("text.normalize_case")
def normalize_case(table: Table, options: dict) -> Plan:
    """``case``: ``lower`` (also for unknown names), ``upper`` or ``title``."""
    case = (options.get("case") or "lower").lower()
    convert = {"upper": F.upper, "title": fn.title}.get(case, F.lower)
    case = case if case in ("upper", "title") else "lower"
    columns = table.text_columns(options.get("columns"))
    if not columns:
        return Plan({"columns_normalized": 0})
    types = table.types()
    changes = [
        Change(name, [convert(fn.as_text(fn.col(name), types[name]))], keeps_null=True) for name in columns
    ]
    return Plan({"columns_normalized": len(columns), "case": case}, changes)


def _counted(table: Table, columns: list[str], convert) -> Plan:
    types = table.types()
    changes = [
        Change(
            name,
            [convert(fn.as_text(fn.col(name), types[name]))],
            counts=lambda old, work, dtype=types[name]: {
                "values_changed": differs(fn.as_text(old, dtype), work)
            },
            keeps_null=True,
        )
        for name in columns
    ]
    return Plan({"columns_processed": len(columns), "values_changed": 0}, changes)


@planner("text.remove_non_printable")
def remove_non_printable(table: Table, options: dict) -> Plan:
    """Delete control characters, then on request ``collapse_whitespace`` and ``strip``.

    Tabs and line ends are control characters too: they are deleted, not turned into blanks.
    """

    def convert(value):
        value = fn.remove_control(value)
        if options.get("collapse_whitespace"):
            value = fn.collapse_whitespace(value)
        return fn.strip(value) if options.get("strip") else value

    return _counted(table, table.text_columns(options.get("columns")), convert)


@planner("text.normalize_for_matching")
def normalize_for_matching(table: Table, options: dict) -> Plan:
    """Lower-case and trim; by default ``remove_punctuation`` and ``collapse_whitespace``."""
    punctuation = options.get("remove_punctuation", True)
    collapse = options.get("collapse_whitespace", True)
    return _counted(
        table,
        table.text_columns(options.get("columns")),
        lambda value: fn.match_key(value, punctuation, collapse),
    )

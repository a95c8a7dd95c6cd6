"""Steps that take rows away."""

from __future__ import annotations

from .base import Dedupe, Filter, Plan, Table, planner


@planner("core.drop_empty")
def drop_empty(table: Table, options: dict) -> Plan:
    """Drop rows that are null in every column of ``subset`` (all). Blank text is not null."""
    subset = options.get("subset")
    if subset is not None:
        missing = [name for name in subset if name not in table.names]
        if missing:
            raise KeyError(f"drop_empty: missing columns {missing}")
    checked = table.names if subset is None else subset
    return Plan(keep=Filter(list(checked), "all"), removed_as="dropped_empty")


@planner("core.drop_rows_missing_required")
def drop_rows_missing_required(table: Table, options: dict) -> Plan:
    """Drop rows with a null in ``any`` or ``all`` (``how``) of the required ``columns``."""
    how = (options.get("how") or "any").lower()
    how = how if how in ("any", "all") else "any"
    required = table.present(options.get("columns"))
    if not required:
        return Plan({"rows_dropped": 0})
    return Plan(
        {"rows_dropped": 0, "required_columns": required, "how": how},
        keep=Filter(required, how),
        removed_as="rows_dropped",
    )


@planner("dedupe.drop_duplicates")
def drop_duplicates(table: Table, options: dict) -> Plan:
    """Keep the ``first`` or ``last`` of equal rows, or (false) none; ``subset``: the key columns."""
    subset = options.get("subset")
    keep = options.get("keep", "first")
    if keep not in ("first", "last", False):
        raise ValueError(f"drop_duplicates: keep must be 'first', 'last' or False, not {keep!r}")
    if subset is not None:
        subset = [subset] if isinstance(subset, str) else list(subset)
        missing = [name for name in subset if name not in table.names]
        if missing or not subset:
            raise KeyError(f"drop_duplicates: missing columns {missing or 'in an empty subset'}")
    return Plan(dedupe=Dedupe(subset, keep), removed_as="duplicates_removed")

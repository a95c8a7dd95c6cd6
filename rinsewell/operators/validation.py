"""Steps that give cells a type or a standard form."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, functions as F

from .. import functions as fn
from ..functions.parse import layout_of, number_text, swap_day_month
from .base import Change, Plan, Table, differs, merge_lists, planner, when_set


# Fixed value: how far a number may move to become a float.
FLOAT_TOLERANCE = 5e-4


def _coerced(table: Table, columns: list[str], errors: str, text, parse, refine=None) -> Plan:
    """Replace columns by their parsed values; ``errors`` says what an unparsed value means."""
    types = table.types()
    sources = {name: text(fn.as_text(fn.col(name), types[name])) for name in columns}
    parsed = {name: parse(name, source) for name, source in sources.items()}
    untouched = set()
    if errors == "ignore" and columns:
        # Columns with any unparsed value keep their text: one aggregation tells which.
        def look() -> list[str]:
            failed = table.rows.agg(
                *[
                    F.bool_or(fn.col(name).isNotNull() & parsed[name].isNull()).alias(f"c{i}")
                    for i, name in enumerate(columns)
                ]
            ).first()
            return [name for i, name in enumerate(columns) if failed[i]]

        untouched = set(table.find("columns with unparsed values", look, merge_lists))
    if refine:
        parsed = refine(parsed)
    changes = []
    for name in columns:
        work = sources[name] if name in untouched else parsed[name]
        if errors == "raise":
            message = F.concat(F.lit(f"{name}: cannot parse "), sources[name])
            blank = fn.is_blank(sources[name])
            work = F.when(
                sources[name].isNotNull() & ~blank & work.isNull(), F.raise_error(message)
            ).otherwise(work)
        changes.append(
            Change(
                name,
                [work],
                counts=lambda old, work: {
                    "values_converted": when_set(old, work.isNotNull()),
                    "values_failed": when_set(old, work.isNull()),
                },
            )
        )
    return Plan(
        {"columns_processed": len(columns), "values_converted": 0, "values_failed": 0},
        changes,
        raises=errors == "raise",
    )


def _downcast(table: Table, parsed: dict[str, Column], to: str) -> dict[str, Column]:
    """Smallest type that holds every value: one aggregation over all columns finds the ranges.

    A float holds a column if no value moves by more than ``FLOAT_TOLERANCE``.
    """
    if to == "float":

        def look_apart() -> dict[str, float]:
            infinite = [F.abs(value) == float("inf") for value in parsed.values()]
            moved = [F.max(F.when(~i, F.abs(v - v.cast("float")))) for v, i in zip(parsed.values(), infinite)]
            return {name: apart or 0 for name, apart in zip(parsed, table.rows.agg(*moved).first())}

        moved = table.find("distance to floats", look_apart, lambda old, new: {n: max(old[n], new[n]) for n in new})
        return {n: value.cast("float") if moved[n] <= FLOAT_TOLERANCE else value for n, value in parsed.items()}

    def look() -> dict[str, list]:
        aggregates = []
        for value in parsed.values():
            aggregates += [F.min(value), F.max(value), F.bool_and(value == F.floor(value))]
        found = table.rows.agg(*aggregates).first()
        return {name: list(found[3 * i : 3 * i + 3]) for i, name in enumerate(parsed)}

    ranges = table.find("ranges", look, lambda old, new: {n: _wider(old[n], new[n]) for n in new})
    result = {}
    for name, value in parsed.items():
        low, high, whole = ranges[name]
        result[name] = value
        if whole and (to != "unsigned" or low >= 0):
            for bits, dtype in ((8, "byte"), (16, "short"), (32, "int"), (64, "long")):
                if -(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1):
                    result[name] = value.cast(dtype)
                    break
    return result


def _wider(a: list, b: list) -> list:
    """Two (low, high, whether all are whole) as one; all three are None where there are no values."""
    if a[0] is None or b[0] is None:
        return b if a[0] is None else a
    return [min(a[0], b[0]), max(a[1], b[1]), a[2] and b[2]]


@planner("validation.coerce_numeric")
def coerce_numeric(table: Table, options: dict) -> Plan:
    """Parse ``columns`` as doubles.

    ``strip_commas`` (true), ``strip_currency`` (false), ``errors`` (``coerce``, ``raise``,
    ``ignore``), ``downcast`` (``integer``, ``signed``, ``unsigned``, ``float``).
    """
    downcast = options.get("downcast")
    return _coerced(
        table,
        table.present(dict.fromkeys(options.get("columns") or [])),
        options.get("errors", "coerce"),
        lambda value: number_text(
            value, options.get("strip_commas", True), options.get("strip_currency", False)
        ),
        lambda name, text: fn.parse_number(text),
        (lambda parsed: _downcast(table, parsed, downcast)) if downcast else None,
    )


def _first_values(table: Table, columns: list[str]) -> list[Column]:
    """Aggregates that find the first value of each column in table order."""
    if table.order is None:
        raise ValueError(
            "coerce_datetime without a format takes it from the first value: name order_by columns"
        )
    types = table.types()
    texts = [fn.as_text(fn.col(name), types[name]).alias("text") for name in columns]
    firsts = [F.min(F.when(text.isNotNull(), F.struct(table.order, text))) for text in texts]
    return [first["text"].alias(f"__layout_{i}") for i, first in enumerate(firsts)]


def _layouts_by_scope(table: Table, columns: list[str], dayfirst: bool):
    """The layout of each column in each scope, as a table, and all layouts met in each column."""

    names = [f"__layout_{i}" for i in range(len(columns))]
    firsts = table.rows.groupBy(*table.scope).agg(*_first_values(table, columns))
    layouts = firsts.withColumns({name: layout_of(F.col(name), dayfirst) for name in names})
    met = layouts.agg(*[F.collect_set(n).alias(n) for n in names]).first()
    found = {name: sorted(met[hidden]) for name, hidden in zip(columns, names)}
    return layouts, found


@planner("validation.coerce_datetime")
def coerce_datetime(table: Table, options: dict) -> Plan:
    """Parse ``columns`` as timestamps by ``format``, or by the layout of the first value.

    Without a recognisable first value each cell is parsed by the first common layout it fits.
    ``dayfirst``, ``utc``, ``errors`` (``coerce``, ``raise``, ``ignore``).
    """
    columns = table.present(dict.fromkeys(options.get("columns") or []))
    dayfirst, utc = options.get("dayfirst", False), options.get("utc", False)
    errors = options.get("errors", "coerce")

    def any_layout(text: Column, instants: bool = utc) -> Column:
        common = fn.DATE_LAYOUTS
        if dayfirst:
            common = [swap_day_month(layout) for layout in common]
        # Values of another order (13/06/2024) are read the only way that makes a date.
        swapped = [swap_day_month(layout) for layout in fn.DATE_LAYOUTS] + fn.DATE_LAYOUTS
        tried = list(dict.fromkeys([*common, *swapped]))
        return F.coalesce(*[fn.parse_datetime(fn.strip(text), layout, instants) for layout in tried])

    lookup, layouts = None, dict.fromkeys(columns, options.get("format"))
    if options.get("format") or not columns:

        def parse(name: str, text: Column) -> Column:
            return fn.parse_datetime(text, options["format"], utc)

    elif table.scope and errors != "ignore":
        lookup, met = _layouts_by_scope(table, columns, dayfirst)

        def parse(name: str, text: Column) -> Column:
            layout = F.col(f"__layout_{columns.index(name)}")
            instants = utc or any("%z" in known for known in met[name])  # one type for all scopes
            parsed = F.when(layout.isNull(), any_layout(text, instants))
            for known in met[name]:
                parsed = parsed.when(layout == known, fn.parse_datetime(text, known, instants))
            return parsed

    else:

        def look() -> dict[str, str | None]:
            firsts = table.rows.agg(*_first_values(table, columns))
            found = firsts.select(*[layout_of(F.col(f"__layout_{i}"), dayfirst) for i in range(len(columns))]).first()
            return dict(zip(columns, found))

        layouts = table.find("layouts", look, lambda old, new: {n: old[n] or new[n] for n in new})

        def parse(name: str, text: Column) -> Column:
            known = layouts[name]
            return fn.parse_datetime(text, known, utc) if known else any_layout(text)

    plan = _coerced(table, columns, errors, lambda value: value, parse)
    whole_days = {n for n, known in layouts.items() if known and not utc and not re.search("%[HIMSfpz]", known)}
    changes = [replace(change, dates=change.name in whole_days) for change in plan.changes]
    return replace(plan, changes=changes, lookup=lookup)


def _standardized(
    table: Table, columns: list[str], text, convert, bad: str, changed=differs
) -> Plan:
    """Write the standard form over valid cells; the others keep their text and are counted."""
    types = table.types()
    changes = []
    for name in columns:
        raw = text(fn.as_text(fn.col(name), types[name]))
        changes.append(
            Change(
                name,
                [raw, convert(raw)],
                value=lambda old, raw, new: F.coalesce(new, raw),
                counts=lambda old, raw, new: {
                    "values_changed": changed(raw, new),
                    bad: when_set(old, new.isNull()),
                },
                keeps_null=True,
            )
        )
    return Plan({"columns_processed": len(columns), "values_changed": 0, bad: 0}, changes)


def _choice(options: dict, allowed: list[str]) -> str:
    """The ``output`` option; the first allowed value where it is missing or unknown."""
    output = (options.get("output") or allowed[0]).lower()
    return output if output in allowed else allowed[0]


@planner("validation.standardize_phone")
def standardize_phone(table: Table, options: dict) -> Plan:
    """US numbers in ``columns``; ``output``: ``us``, ``digits``, ``e164``; ``keep_country_code``."""
    output = _choice(options, ["us", "digits", "e164"])
    keep = bool(options.get("keep_country_code", True))
    return _standardized(
        table,
        table.present(dict.fromkeys(options.get("columns") or [])),
        lambda value: value,
        lambda value: fn.phone(value, output, keep),
        "values_invalid",
    )


@planner("validation.standardize_zip")
def standardize_zip(table: Table, options: dict) -> Plan:
    """ZIP codes in ``columns``; ``output``: ``zip5`` or ``zip9``. Invalid text is trimmed only."""
    output = _choice(options, ["zip5", "zip9"])
    return _standardized(
        table,
        table.present(dict.fromkeys(options.get("columns") or [])),
        fn.strip,
        lambda value: fn.zip_code(value, output),
        "values_invalid",
    )


@planner("validation.standardize_state")
def standardize_state(table: Table, options: dict) -> Plan:
    """US states in ``columns``; ``output``: ``abbr`` or ``name``. A change of case is no change."""
    output = _choice(options, ["abbr", "name"])
    return _standardized(
        table,
        table.present(dict.fromkeys(options.get("columns") or [])),
        lambda value: value,
        lambda value: fn.state(value, output),
        "values_unmapped",
        changed=lambda raw, new: differs(F.lower(fn.strip(raw)), F.lower(new)),
    )

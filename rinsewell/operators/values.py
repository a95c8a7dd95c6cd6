"""Steps that fill, replace and null out values."""

from __future__ import annotations

from numbers import Number

from pyspark.sql import Column, functions as F, types as T

from ..functions import as_text, col, is_text, strip
from .base import Change, Plan, Table, merge_lists, planner, when_set

_WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _fits(value, dtype: T.DataType) -> bool:
    """Whether a Python value can be stored in a column of this type as it is."""
    if is_text(dtype):
        return isinstance(value, str)
    if isinstance(value, bool) or isinstance(dtype, T.BooleanType):
        return isinstance(value, bool) and isinstance(dtype, T.BooleanType)
    if type(dtype) in _WHOLE:
        bits = _WHOLE[type(dtype)]
        return isinstance(value, Number) and value == int(value) and abs(value) < 2 ** (bits - 1)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return isinstance(value, Number)
    return False


def _literal(value, dtype: T.DataType) -> Column:
    return F.lit(int(value) if type(dtype) in _WHOLE else value).cast(dtype)


def _widen(column: Column, dtype: T.DataType, values: list) -> tuple[Column, T.DataType]:
    """The column in a type that also holds the values: its own, double, or else text."""
    if all(_fits(value, dtype) for value in values):
        return column, dtype
    if isinstance(dtype, T.NumericType) and all(_fits(value, T.DoubleType()) for value in values):
        return column.cast("double"), T.DoubleType()
    return as_text(column, dtype), T.StringType()


@planner("core.fill_nulls")
def fill_nulls(table: Table, options: dict) -> Plan:
    """``values``: fill value by column; or ``value`` for ``columns`` (all)."""
    by_column = options.get("values") or {}
    single = options.get("value")
    if by_column:
        fill = {name: by_column[name] for name in table.present(by_column)}
    elif single is not None:
        columns = options.get("columns")
        fill = dict.fromkeys(table.names if columns is None else table.present(columns), single)
    else:
        fill = {}
    if not fill:
        return Plan({"columns_filled": 0, "nulls_filled": 0})
    types = table.types()
    # A column without nulls keeps its type: one aggregation looks at those that would get another.
    other = [n for n, v in fill.items() if v is not None and _widen(col(n), types[n], [v])[1] != types[n]]

    def look() -> list[str]:
        holes = table.rows.agg(*[F.bool_or(col(n).isNull()) for n in other]).first()
        return [name for name, hole in zip(other, holes) if hole]

    full = set(other) - set(table.find("columns with nulls", look, merge_lists) if other else [])
    changes = []
    for name, value in fill.items():
        if value is None or name in full:
            continue
        old, dtype = _widen(col(name), types[name], [value])
        value = str(value) if is_text(dtype) else value
        changes.append(
            Change(
                name,
                [F.coalesce(old, _literal(value, dtype))],
                counts=lambda old, work: {"nulls_filled": old.isNull().cast("int")},
            )
        )
    return Plan({"columns_filled": len(fill), "nulls_filled": 0}, changes)


@planner("text.normalize_empty_strings")
def normalize_empty_strings(table: Table, options: dict) -> Plan:
    """Null out blank text and the ``empty_values``, compared after trimming, in ``columns`` (text)."""
    columns = table.text_columns(options.get("columns"))
    empty = ["", *(str(value) for value in options.get("empty_values") or [])]
    types = table.types()
    changes = [
        Change(
            name,
            [strip(as_text(col(name), types[name])).isin(empty)],
            value=lambda old, work: F.when(~work, old),
            counts=lambda old, work: {"values_replaced": when_set(old, work)},
        )
        for name in columns
    ]
    return Plan({"columns_processed": len(columns), "values_replaced": 0}, changes)


def resolve_chain(mapping: dict) -> dict:
    """Where each old value ends up, and after how many replacements.

    Pairs apply one after the other to the current value, so ``{a: b, b: c}`` turns ``a`` into
    ``c`` in two replacements while ``{b: c, a: b}`` turns it into ``b`` in one.
    """
    ends = {}
    for start in mapping:
        value, hits = start, 0
        for old, new in mapping.items():
            if value is not None and value == old:
                value, hits = new, hits + 1
        ends[start] = (value, hits)
    return ends


@planner("text.replace_values")
def replace_values(table: Table, options: dict) -> Plan:
    """``mapping``: old to new value for ``columns`` (all); ``mappings``: the same by column.

    The match is exact. A key matches only cells of its own kind: text keys never match numbers.
    """
    mapping = options.get("mapping") or {}
    by_column = options.get("mappings") or {}
    columns = options.get("columns")
    columns = table.names if columns is None else table.present(columns)
    if not columns or not (mapping or by_column):
        return Plan({"columns_processed": 0, "replacements": 0})
    types = table.types()
    changes = []
    for name in dict.fromkeys(columns):
        dtype = types[name]
        chain = {
            old: end
            for old, end in resolve_chain(by_column.get(name) or mapping).items()
            if old is not None and _fits(old, dtype)
        }
        if not chain:
            continue
        ends = [end for end, _ in chain.values() if end is not None]
        widened, after = _widen(col(name), dtype, ends)
        entries = []
        for old, (end, hits) in chain.items():
            end = str(end) if is_text(after) and end is not None else end
            new = F.lit(None).cast(after) if end is None else _literal(end, after)
            entries += [_literal(old, dtype), F.struct(new.alias("new"), F.lit(hits).alias("hits"))]
        changes.append(
            Change(
                name,
                [F.try_element_at(F.create_map(*entries), col(name)), widened],
                value=lambda old, hit, widened: F.when(hit.isNotNull(), hit["new"]).otherwise(widened),
                counts=lambda old, hit, widened: {
                    "replacements": F.coalesce(hit["hits"], F.lit(0))
                },
            )
        )
    return Plan({"columns_processed": len(columns), "replacements": 0}, changes)

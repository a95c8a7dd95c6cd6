"""Types as a lattice: the least type that holds the values of two, and the way there."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from .names import as_text, is_text

_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_FLOATING = (T.FloatType, T.DoubleType)
_DIGITS = dict(zip(_WHOLE, (3, 5, 10, 19)))


def _decimal(dtype: T.DataType) -> T.DecimalType | None:
    return dtype if isinstance(dtype, T.DecimalType) else T.DecimalType(_DIGITS[type(dtype)], 0) if type(dtype) in _DIGITS else None


def _join(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if type(a) in _WHOLE and type(b) in _WHOLE:
        return a if _WHOLE.index(type(a)) > _WHOLE.index(type(b)) else b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, _FLOATING) or isinstance(b, _FLOATING):
            return T.DoubleType()
        one, two = _decimal(a), _decimal(b)
        scale = max(one.scale, two.scale)
        size = max(one.precision - one.scale, two.precision - two.scale) + scale
        return T.DecimalType(size, scale) if size <= 38 else T.StringType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    return T.StringType()


def join_types(types: Iterable[T.DataType]) -> T.DataType:
    """The least type that holds all values of the given ones: null, then whole numbers by width, decimals and
    doubles, then text; a date is a time at midnight. All that have nothing else in common are text."""
    return reduce(_join, types, T.NullType())


def to_type(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """A cell in a type that ``join_types`` found for it; it is never lost and never an error."""
    if source == target or (is_text(source) and is_text(target)):
        return value
    if not is_text(target):
        return value.cast(target)
    if isinstance(source, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(value)
    if isinstance(source, T.BinaryType):
        return F.base64(value)
    if isinstance(source, T.TimestampType):  # an instant, whatever the session's time zone
        utc = F.timestamp_add("MICROSECOND", F.unix_micros(value), F.expr("TIMESTAMP_NTZ'1970-01-01'"))
        return F.concat(utc.cast("string"), F.lit("+00:00"))
    return as_text(value, source)

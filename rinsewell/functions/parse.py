"""Numbers and timestamps from text; NULL where the text does not parse."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

# ``1_000``, ``5d``, ``0x1A`` and non-ASCII digits are not numbers, whatever a cast may think.
NUMBER = r"(?i)\A\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*\z"
# Fixed value: currency signs taken off either end.
_CURRENCY = r"(?U)\A\s*[$£€]|\s*[$£€]\s*\z"


def number_text(value: Column, strip_commas: bool = True, strip_currency: bool = False) -> Column:
    """The text without thousands commas and without one currency sign at either end."""
    from .text import strip

    if strip_commas:
        value = F.replace(value, F.lit(","), F.lit(""))
    if strip_currency:
        value = strip(F.regexp_replace(value, _CURRENCY, ""))
    return value


def parse_number(text: Column) -> Column:
    """A double; a number too large for one is NULL, a written infinity is kept."""
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    overflow = (F.abs(number) == float("inf")) & ~text.rlike("(?i)inf")
    return F.when(~overflow, number)


# Strftime directive -> (formatter letters, the same next to another number, digits).
_DIRECTIVES = {
    "Y": ("yyyy", "yyyy", r"\d{4}"),
    "y": ("yy", "yy", r"\d{2}"),
    "m": ("M", "MM", r"\d{1,2}"),
    "d": ("d", "dd", r"\d{1,2}"),
    "j": ("D", "DDD", r"\d{1,3}"),
    "H": ("H", "HH", r"\d{1,2}"),
    "I": ("h", "hh", r"\d{1,2}"),
    "M": ("m", "mm", r"\d{1,2}"),
    "S": ("s", "ss", r"\d{1,2}"),
    "f": ("SSSSSSSSS", "SSSSSSSSS", r"\d{1,9}"),
    "b": ("MMM", "MMM", r"[A-Za-z]{3}"),
    "B": ("MMMM", "MMMM", r"[A-Za-z]{3,9}"),
    "p": ("a", "a", r"[AaPp][Mm]"),
    "z": ("[XXX][XX]", "[XXX][XX]", r"(Z|[+-]\d{2}:?\d{2})"),
}

# Layouts tried one after the other when no single layout fits the column (month before day).
DATE_LAYOUTS = [
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%dT%H:%M",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%Y/%m/%d",
    "%Y/%m/%d %H:%M",
    "%Y/%m/%d %H:%M:%S",
    "%m/%d/%Y",
    "%m/%d/%Y %H:%M",
    "%m/%d/%Y %H:%M:%S",
    "%m/%d/%Y %I:%M %p",
    "%m/%d/%y",
    "%m-%d-%Y",
    "%m.%d.%Y",
    "%Y%m%d",
    "%b %d, %Y",
    "%B %d, %Y",
    "%d %b %Y",
    "%d %B %Y",
    "%d-%b-%Y",
    "%Y-%m",
    "%b %Y",
    "%B %Y",
    "%Y",
]

# The range of a 64-bit count of nanoseconds around 1970.
_FIRST, _LAST = "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775"
_CENTURY = 36_525 * 86_400_000_000


def strftime_layout(layout: str) -> tuple[str, str]:
    """Translate a strftime layout to a formatter pattern and a regex of the texts it can match.

    One-letter fields take one or two digits, as strptime does. Fields that touch another number
    (``%Y%m%d``) need their full width to be told apart.
    """
    parts = re.findall(r"%.|[^%]+", layout, flags=re.DOTALL)
    numeric = [p[0] == "%" and p[1] in "YymdjHIMSf" for p in parts]
    pattern, guard = "", ""
    for i, part in enumerate(parts):
        if part[0] == "%" and part[1] in _DIRECTIVES:
            alone, packed, digits = _DIRECTIVES[part[1]]
            touching = numeric[i] and (
                (i > 0 and numeric[i - 1]) or (i + 1 < len(parts) and numeric[i + 1])
            )
            pattern += packed if touching else alone
            guard += re.sub(r"\{1,(\d)\}", r"{\1}", digits) if touching and part[1] != "f" else digits
        elif part[0] == "%" and part[1] != "%":
            raise ValueError(f"unsupported date directive {part!r} in {layout!r}")
        else:
            text = "%" if part[0] == "%" else part
            pattern += "".join("''" if c == "'" else f"'{c}'" if c.isalpha() else c for c in text)
            guard += re.sub(r"([^\w\s])", r"\\\1", text)
    return pattern, rf"\A{guard}\z"


def parse_datetime(text: Column, layout: str, utc: bool = False) -> Column:
    """Parse by one strftime layout, without regard to the session's time zone.

    The result is a timestamp without time zone, or with ``utc`` (or an offset in the layout) an
    instant. Impossible dates, and dates outside 1677 to 2262, are NULL.
    """
    pattern, guard = strftime_layout(layout)
    offset = "%z" in layout
    # A guard keeps plain garbage away from the formatter, which reports failures by exceptions.
    source = F.when(text.rlike(guard), text if offset else F.concat(text, F.lit("Z")))
    instant = F.try_to_timestamp(source, F.lit(pattern if offset else pattern + "X"))
    micros = F.unix_micros(instant)
    if "%y" in layout:
        # The formatter reads 00 to 99 as 20xx; 69 to 99 mean 19xx, always 36,525 days earlier.
        micros = F.when(micros < _micros("2069-01-01"), micros).otherwise(micros - _CENTURY)
    micros = F.when(micros.between(_micros(_FIRST), _micros(_LAST)), micros)
    if utc or offset:
        return F.timestamp_micros(micros)
    return F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ'1970-01-01'"))


def _micros(moment: str) -> int:
    return (datetime.fromisoformat(moment) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def swap_day_month(layout: str) -> str:
    """The same layout with the day before the month, where both are numbers."""
    if "%m/%d" in layout or "%m-%d-%Y" in layout or "%m.%d" in layout:
        return layout.replace("%m", "\0").replace("%d", "%m").replace("\0", "%d")
    return layout


def layout_of(text: Column, dayfirst: bool = False) -> Column:
    """The strftime layout of an example value, among ``DATE_LAYOUTS`` with and without an offset: the first that the
    text is a possible date of, or null. Where day and month can be told apart neither way, ``dayfirst`` decides."""
    clear = [layout for layout in DATE_LAYOUTS if "%y" not in layout and "%p" not in layout]
    clear += [layout + "%z" for layout in clear if "%M" in layout]
    clear.sort(key=lambda layout: "%b" in layout)  # May is a full name
    other = [re.sub("%m(.)%d", r"%d\1%m", layout) for layout in clear]
    if dayfirst:
        tried = [*other, *clear]
        tried.remove("%Y%m%d")
        tried.remove("%Y%m%d")
    else:
        tried = [*clear, *map(swap_day_month, clear)]
    fits = [F.when(parse_datetime(text, layout, True).isNotNull(), layout) for layout in dict.fromkeys(tried)]
    return F.coalesce(*fits)

"""Column functions against plain Python on many code points and random texts."""

import random
import re

import pytest

from rinsewell import functions as fn
from rinsewell.functions.parse import layout_of, number_text

ODD = "aB3ßé_-'.,\t\n\x1c\x85\xa0 　​É½²ΑΣ ǆ€ 漢٣"


def texts(n=400, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choices(ODD, k=pick.randint(0, 12))) for _ in range(n)]


# Code points known to Java 17 and to Python alike; newer ones differ by Unicode version only.
POINTS = [chr(i) for i in [*range(1, 0x860), *range(0x1E00, 0x2C00), *range(0x3000, 0x3100)]]


def test_strip(column):
    values = [*texts(), *[f"{c}x{c}" for c in POINTS]]
    assert column(values, fn.strip) == [v.strip() for v in values]


def test_whitespace_is_complete():
    assert set(fn.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_collapse(column):
    values = [*texts(), *[f"x{c}{c}y" for c in POINTS]]
    assert column(values, fn.collapse_whitespace) == [re.sub(r"\s+", " ", v) for v in values]


def test_remove_control(column):
    values = texts()
    assert column(values, fn.remove_control) == [re.sub(r"[\x00-\x1f\x7f]", "", v) for v in values]


@pytest.mark.parametrize("punctuation", [True, False])
@pytest.mark.parametrize("collapse", [True, False])
def test_match_key(column, punctuation, collapse):
    def expected(value):
        value = value.strip().lower()
        if punctuation:
            value = re.sub(r"[^\w\s]", "", value)
        return re.sub(r"\s+", " ", value).strip() if collapse else value

    values = [*texts(), "a-b_c ½²", "- a"]
    found = column(values, lambda c: fn.match_key(c, punctuation, collapse))
    assert found == [expected(v) for v in values]


def test_title(column):
    values = [
        *texts(),
        "o'neil jean-luc 3rd ß mcDonald",
        *[f"{c}ab" for c in POINTS if c not in "ƛɤ"],
    ]
    assert column(values, fn.title) == [v.title() for v in values]


def test_numbers(column):
    good = {"$1,200": 1200.0, "€ 7": 7.0, "5 $": 5.0, "$-5": -5.0, "1e3": 1000.0, ".5": 0.5, "1.": 1.0}
    good |= {" 12 ": 12.0, "-Infinity": float("-inf"), "INF": float("inf"), "+7": 7.0}
    bad = ["-$5", "$$5", "(5)", "1_000", "5d", "1e400", "0x1A", "1e", "", "  ", "abc", "٣", "5%", "nan"]
    values = [*good, *bad]
    found = column(values, lambda c: fn.parse_number(number_text(c, True, True)))
    assert found == [*good.values(), *[None] * len(bad)]


def test_float_text(column):
    values = [1.0, 12345678.5, 1e15, 1e16, 0.00012, 0.00001, -2.5e10, 123456789012.25]
    found = column(values, lambda c: fn.as_text(c, __import__("pyspark").sql.types.DoubleType()), "double")
    assert found[:4] == ["1.0", "12345678.5", "1000000000000000.0", "1.0E16"]
    assert found[4:] == ["0.00012", "1.0E-5", "-25000000000.0", "123456789012.25"]


DATES = [
    ("%Y-%m-%d", "2024-1-5", "2024-01-05 00:00:00"),
    ("%Y-%m-%d", "2024-02-30", None),
    ("%Y-%m-%d", "9999-12-31", None),
    ("%Y-%m-%d", " 2024-01-05", None),
    ("%m/%d/%y", "1/5/69", "1969-01-05 00:00:00"),
    ("%m/%d/%y", "1/5/68", "2068-01-05 00:00:00"),
    ("%Y-%m-%d %H:%M", "2024-03-10 02:30", "2024-03-10 02:30:00"),  # no such time in New York
    ("%Y%m%d", "20240105", "2024-01-05 00:00:00"),
    ("%b %d, %Y", "JAN 5, 2024", "2024-01-05 00:00:00"),
    ("%m/%d/%Y %I:%M %p", "01/06/2024 1:05 pm", "2024-01-06 13:05:00"),
    ("%Y-%m-%d %H:%M:%S.%f", "2024-01-05 10:00:00.5", "2024-01-05 10:00:00.500000"),
    ("%Y-%m-%dT%H:%M:%S%z", "2024-01-05T10:00:00+0200", "2024-01-05 08:00:00"),
]


@pytest.mark.parametrize("layout,text,expected", DATES)
def test_dates(spark, layout, text, expected):
    from pyspark.sql import functions as F

    parsed = fn.parse_datetime(F.lit(text), layout)
    if "%z" in layout:
        parsed = F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), parsed.cast("timestamp_ntz"))
    found = spark.range(1).select(parsed.alias("t")).first()["t"]
    assert (found and str(found)) == expected


def test_guess(column):
    values = ["2024-01-05", "13/06/2024", "01/06/2024", "garbage", "2024-02-30", None]
    assert column(values, layout_of) == ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", None, None, None]
    assert column(values, lambda v: layout_of(v, dayfirst=True))[1:3] == ["%d/%m/%Y", "%d/%m/%Y"]


def test_phone(column):
    values = ["15551234567", "25551234567", "(555) 123-4567", "555.123.456", "1234567890", "x"]
    us = ["+1 (555) 123-4567", None, "+1 (555) 123-4567", None, "+1 (123) 456-7890", None]
    assert column(values, fn.phone) == us
    assert column(values[:1], lambda c: fn.phone(c, "e164")) == ["+15551234567"]
    assert column(values[:1], lambda c: fn.phone(c, "e164", False)) == ["5551234567"]
    assert column(values[:1], lambda c: fn.phone(c, "digits")) == ["5551234567"]
    assert column(values[:1], lambda c: fn.phone(c, "us", False)) == ["(555) 123-4567"]


def test_zip(column):
    values = ["12345", "12345-6789", "123456789", "123", "1-2-3-4-5"]
    assert column(values, fn.zip_code) == ["12345", "12345", "12345", None, "12345"]
    assert column(values[1:3], lambda c: fn.zip_code(c, "zip9")) == ["12345-6789"] * 2


def test_state(column):
    values = ["new-york", " ny ", "Ontario", "DC", "", "District of Columbia", "new  york"]
    assert column(values, fn.state) == ["NY", "NY", None, "DC", None, "DC", None]
    named = column(values[:4], lambda c: fn.state(c, "name"))
    assert named == ["New York", "New York", None, "District of Columbia"]

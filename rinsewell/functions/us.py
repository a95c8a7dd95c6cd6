"""US phone numbers, ZIP codes and states. Each function gives NULL where the text is not valid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# The 50 states and the District of Columbia.
STATES = {
    "AL": "Alabama",
    "AK": "Alaska",
    "AZ": "Arizona",
    "AR": "Arkansas",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DE": "Delaware",
    "DC": "District of Columbia",
    "FL": "Florida",
    "GA": "Georgia",
    "HI": "Hawaii",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "IA": "Iowa",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "ME": "Maine",
    "MD": "Maryland",
    "MA": "Massachusetts",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MS": "Mississippi",
    "MO": "Missouri",
    "MT": "Montana",
    "NE": "Nebraska",
    "NV": "Nevada",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NY": "New York",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VT": "Vermont",
    "VA": "Virginia",
    "WA": "Washington",
    "WV": "West Virginia",
    "WI": "Wisconsin",
    "WY": "Wyoming",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\P{Nd}+", "")


def phone(value: Column, output: str = "us", keep_country_code: bool = True) -> Column:
    """Ten digits, optionally after a 1, written as ``us``, ``e164`` or ``digits``."""
    pick = {
        ("us", True): "+1 ($1) $2-$3",
        ("us", False): "($1) $2-$3",
        ("e164", True): "+1$1$2$3",
    }.get((output, keep_country_code), "$1$2$3")
    # One anchored replace both checks and formats; any other digit count leaves no match.
    number = r"\A1?(\p{Nd}{3})(\p{Nd}{3})(\p{Nd}{4})\z"
    digits = _digits(value)
    return F.when(digits.rlike(number), F.regexp_replace(digits, number, pick))


def zip_code(value: Column, output: str = "zip5") -> Column:
    """Five digits, or nine written as ``zip5`` or ``zip9``."""
    digits = _digits(value)
    five = F.substring(digits, 1, 5)
    nine = F.concat(five, F.lit("-"), F.substring(digits, 6, 4)) if output == "zip9" else five
    return F.when(F.length(digits) == 5, digits).when(F.length(digits) == 9, nine)


def _lookup(entries: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"'{key}', '{value}'" for key, value in entries.items()) + ")")


def state(value: Column, output: str = "abbr") -> Column:
    """A state by its code or name in any case, hyphens read as blanks."""
    key = F.replace(F.lower(strip(value)), F.lit("-"), F.lit(" "))
    by_code, by_name = {}, {}
    for code, name in STATES.items():
        by_code[code.lower()] = by_name[name.lower()] = name if output == "name" else code
    # Codes have two letters and names four or more, so each key is looked up in one small map only.
    return F.when(F.length(key) <= 3, F.try_element_at(_lookup(by_code), key)).otherwise(
        F.try_element_at(_lookup(by_name), key)
    )

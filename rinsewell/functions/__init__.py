"""Column functions: usable on their own in any ``select``."""

from .names import as_text, col, is_text, quoted
from .parse import DATE_LAYOUTS, parse_datetime, parse_number, strftime_layout
from .text import (
    WHITESPACE,
    collapse_whitespace,
    is_blank,
    match_key,
    remove_control,
    strip,
    title,
)
from .types import join_types, to_type
from .us import phone, state, zip_code

__all__ = [
    "DATE_LAYOUTS",
    "WHITESPACE",
    "as_text",
    "col",
    "collapse_whitespace",
    "is_blank",
    "is_text",
    "join_types",
    "match_key",
    "parse_datetime",
    "parse_number",
    "phone",
    "quoted",
    "remove_control",
    "state",
    "strftime_layout",
    "strip",
    "title",
    "to_type",
    "zip_code",
]

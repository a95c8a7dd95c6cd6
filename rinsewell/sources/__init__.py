"""Tables from files and to files."""

from .csv import infer_types, null_tokens, read_csv
from .json import flatten, read_json
from .order import ORDER_COLUMN, with_position
from .scratch import scratch_folder
from .tables import format_of, read_table, write_table
from .yaml import read_yaml

__all__ = [
    "ORDER_COLUMN",
    "flatten",
    "format_of",
    "infer_types",
    "null_tokens",
    "read_csv",
    "read_json",
    "read_table",
    "read_yaml",
    "scratch_folder",
    "with_position",
    "write_table",
]

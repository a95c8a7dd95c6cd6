"""The cleaning steps. Importing this package registers all of them."""

from . import columns, rows, text, validation, values
from .base import Plan, Table, find_step, step

__all__ = ["Plan", "Table", "columns", "find_step", "rows", "step", "text", "validation", "values"]

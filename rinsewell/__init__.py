"""Cleaning tables with Spark: lists of steps that become one plan, with a report of what changed."""

from . import functions
from .operators import step
from .plans import (
    PRESETS,
    CleanResult,
    clean,
    clean_chunks,
    clean_file,
    clean_files,
    module_totals,
    preset,
    read_reports,
    read_totals,
    report_row,
    run_totals,
    totals_stream,
    union_chunks,
    with_overrides,
    write_report,
)
from .sources import flatten, infer_types, null_tokens, read_table, write_table
from .streaming import clean_stream, clean_stream_batches, reported_stream

__all__ = [
    "PRESETS",
    "CleanResult",
    "clean",
    "clean_chunks",
    "clean_file",
    "clean_files",
    "clean_stream",
    "clean_stream_batches",
    "flatten",
    "functions",
    "infer_types",
    "module_totals",
    "null_tokens",
    "preset",
    "read_reports",
    "read_table",
    "read_totals",
    "report_row",
    "reported_stream",
    "run_totals",
    "totals_stream",
    "step",
    "union_chunks",
    "with_overrides",
    "write_report",
    "write_table",
]

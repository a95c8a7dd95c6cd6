"""Running steps, and reports about runs."""

from .chunked import chunk_of, clean_chunks, number_rows, union_chunks
from .clean import CleanResult, clean, with_overrides
from .presets import PRESETS, preset
from .report import module_totals, read_reports, read_totals, report_row, run_totals, totals_stream, write_report
from .run import clean_file, clean_files

__all__ = [
    "PRESETS",
    "CleanResult",
    "chunk_of",
    "clean",
    "clean_chunks",
    "clean_file",
    "clean_files",
    "module_totals",
    "number_rows",
    "preset",
    "read_reports",
    "read_totals",
    "report_row",
    "run_totals",
    "totals_stream",
    "union_chunks",
    "with_overrides",
    "write_report",
]

"""Cleaning tables that arrive in parts."""

from .batches import DecisionLog, clean_stream, clean_stream_batches, first_rows, is_stateless
from .reports import StreamReport, reported_stream

__all__ = [
    "DecisionLog",
    "StreamReport",
    "clean_stream",
    "clean_stream_batches",
    "first_rows",
    "is_stateless",
    "reported_stream",
]

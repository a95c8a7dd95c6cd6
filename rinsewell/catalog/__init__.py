"""Every step, source and report as a runnable query over the given tables, with its SQL twin."""

from .oracle import ORACLE
from .queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]

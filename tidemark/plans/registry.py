"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import archive, lanes, messages, stores, structure  # noqa: F401  they add their queries
from .more_oracle import SQL as MORE
from .oracle import SQL as FIRST
from .telemetry import QUERIES

SQL = FIRST | MORE | lanes.SQL | structure.SQL

__all__ = ["QUERIES", "SQL"]

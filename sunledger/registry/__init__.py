"""Named queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import ingest, monitoring, series, site  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

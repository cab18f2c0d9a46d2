"""The queries of the engine, with the SQL that gives the same rows."""

from . import candidates, cleaning, decisions, files, intake, layout, marked, more, payloads, predicates, quality, records, rendering, search, structure, summaries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

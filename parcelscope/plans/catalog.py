"""All registered queries."""

from . import queries_outreach, queries_report, queries_resolve, queries_sql, queries_streams, queries_text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

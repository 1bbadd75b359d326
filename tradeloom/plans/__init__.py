"""Queries over the given tables, each with a check in SQL."""

from . import campaigns, filters, ledger, metrics, projections, streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

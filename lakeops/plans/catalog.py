"""Importing this module registers every query."""

from lakeops.plans import (  # noqa: F401
    diagnostics_queries, governance_queries, inventory_queries, io_queries, run_queries, sales_queries, storage_queries,
)
from lakeops.plans.registry import ORACLE, QUERIES  # noqa: F401

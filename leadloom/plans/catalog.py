"""All registered queries."""

from leadloom.plans import catalog_rows, catalog_tables, catalog_text  # noqa: F401
from leadloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

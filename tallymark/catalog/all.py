"""Every catalogued query and its SQL twin."""

from tallymark.catalog import conditions, records, sides, tables  # noqa: F401  (they register on import)
from tallymark.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""Table readers and writers."""

from corvane.sources.tables import table, tables

__all__ = ["table", "tables"]

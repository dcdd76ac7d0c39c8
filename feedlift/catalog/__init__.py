"""Registered queries over the test tables, with the SQL that must give the same rows."""

from feedlift.catalog.registry import QUERIES, SQL


def load() -> None:
    """Import every module that registers queries."""
    from feedlift.catalog import branches, column, files, pages, review, sql, warehouse  # noqa: F401


__all__ = ["QUERIES", "SQL", "load"]

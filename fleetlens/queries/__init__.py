"""Importing this package registers every query."""

from fleetlens.queries import audits, checks, content, crawls, logs, monitor, redirects, sites, storage, streams  # noqa: F401
from fleetlens.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

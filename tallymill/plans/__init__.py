"""Registered queries.  Importing this package fills the registry."""

from tallymill.plans import (  # noqa: F401
    aggregates,
    assembly,
    cascades,
    columns,
    comparison,
    extension,
    extraction,
    files,
    reports,
    scoring,
    sketches,
    streams,
)
from tallymill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

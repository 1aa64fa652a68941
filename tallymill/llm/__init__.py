"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from tallymill.llm import queries  # noqa: F401
from tallymill.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

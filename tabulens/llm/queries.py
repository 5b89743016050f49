"""Registers every query of the subpackage."""

from . import (
    model_queries,
    pair_queries,
    rule_queries,
    table_queries,
    text_queries,
)  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of all text operators: the six ASCII characters blank, tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, a null as an empty text."""
    column = F.col(f"`{text}`") if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the runs between white space."""
    return F.array_remove(F.split(text, SPACES), "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def settled(value: Column) -> Column:
    """``value``, computed where it stands.

    Filters and generators over a deterministic column are moved below its projection, with the
    whole expression copied into them, once for each use. A term that the optimiser must not move
    keeps a costly expression in one place.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)

"""Splitting the work on very wide tables by columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TypeVar

Item = TypeVar("Item")

# Columns handled in one job: more would not fit one generated method. Each column is still
# read once, since a job reads only its own.
COLUMNS_PER_JOB = 48


def batches(items: Sequence[Item], size: int = COLUMNS_PER_JOB) -> Iterator[Sequence[Item]]:
    for start in range(0, len(items), size):
        yield items[start : start + size]

"""Exact comparison of all pairs inside clusters, in groups of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.session import pin

# Texts of a group at most, and their elements.
BLOCK = 256
BLOCK_ELEMENTS = 400_000
COLUMNS = 4096

GROUPS = "groups"


def block_groups(member: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster, groups) from (node, component, size); groups is an array of (i, j, part).

    A cluster that fits into a block is one group. A larger one is split by classes of size, whose
    bounds grow by 1 / threshold, so that near texts are at most one class apart, and each class into
    blocks; every pair of blocks of one class or of neighbouring classes is a group (i, j), and
    ``part`` tells in which of the two a text stands. Groups with i = j compare all their texts,
    others only across.
    """
    step = -math.log(threshold)
    sizes = member.groupBy("component").agg(
        ((F.count("*") <= BLOCK) & (F.sum("size") <= 4 * BLOCK_ELEMENTS)).alias("fits")
    )
    placed = member.join(sizes, "component").withColumn(
        "class",
        F.when(F.col("fits"), 0).otherwise(
            F.floor(F.log(F.greatest("size", F.lit(1))) / step + 1e-9).cast("int")
        ),
    )
    blocks = pin(
        placed.groupBy("component", "class", "fits")
        .agg(F.count("*").alias("n"), F.sum("size").alias("all"))
        .select(
            "component",
            "class",
            F.when(F.col("fits"), 1)
            .otherwise(
                F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_ELEMENTS))
            )
            .cast("int")
            .alias("parts"),
        )
    )
    own = placed.join(blocks, ["component", "class"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), "parts").cast("int")
    )
    other = blocks.select(
        "component", F.col("class").alias("other"), F.col("parts").alias("other_parts")
    )
    met = (
        own.join(other, "component")
        .where(F.abs(F.col("class") - F.col("other")) <= 1)
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    )
    here = F.col("class").cast("long") * 2**32 + F.col("block")
    there = F.col("other").cast("long") * 2**32 + F.col("other_block")
    return met.groupBy("node", F.col("component").alias("cluster")).agg(
        F.collect_set(
            F.struct(
                F.least(here, there).alias("i"),
                F.greatest(here, there).alias("j"),
                here.alias("part"),
            )
        ).alias(GROUPS)
    )


def overlaps(owner: np.ndarray, element: np.ndarray, texts: int) -> np.ndarray:
    """Number of common elements of every two texts; elements are distinct within a text."""
    _, column, met = np.unique(element, return_inverse=True, return_counts=True)
    shared = met[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((texts, texts), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, columns, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        there = np.zeros((texts, min(COLUMNS, columns - low)), np.float32)
        there[owner[a:b], column[a:b] - low] = 1.0
        out += there @ there.T  # counts below 2 ** 24 are exact in single precision
    return out


def near_matrix(
    overlap: np.ndarray, size: np.ndarray, threshold: float, across: np.ndarray | None
) -> np.ndarray:
    """Which pairs reach the threshold; with ``across`` only those of different parts."""
    union = size[:, None] + size[None, :] - overlap.astype(np.float64)
    near = (overlap > 0) & (overlap >= threshold * union)
    np.fill_diagonal(near, False)
    if across is not None:
        near &= across[:, None] != across[None, :]
    return near


def each_group(
    batches: Iterator[pa.RecordBatch], compare: Callable[[pa.Table], pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """``compare`` of every run of rows with the same cluster, i and j; holds one run."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in ("cluster", "i", "j"))
        keys = list(zip(*columns, strict=True))
        start = 0
        for at in range(1, len(keys) + 1):
            if at < len(keys) and keys[at] == keys[start]:
                continue
            if key is not None and key != keys[start]:
                yield compare(pa.Table.from_batches(held))
                held = []
            key = keys[start]
            held.append(batch.slice(start, at - start))
            start = at
    if held:
        yield compare(pa.Table.from_batches(held))


def several_groups(
    batches: Iterator[pa.RecordBatch],
    compare: Callable[[pa.Table, list[int]], pa.RecordBatch],
    rows: int,
) -> Iterator[pa.RecordBatch]:
    """``compare`` of whole runs of rows with the same cluster, i and j, about ``rows`` rows at once.

    The second argument has the places where runs start, and the end. Small runs share the cost of a
    call; a run larger than ``rows`` comes alone or last.
    """
    held: list[pa.RecordBatch] = []
    starts: list[int] = []
    size, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in ("cluster", "i", "j")])
        new = np.ones(len(batch), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        new[0] = last is None or (keys[:, 0] != last).any()
        last, done = keys[:, -1], 0
        for at in np.nonzero(new)[0].tolist():
            if size + at - done >= rows:
                held.append(batch.slice(done, at - done))
                yield compare(pa.Table.from_batches(held), [*starts, size + at - done])
                held, starts, size, done = [], [], 0, at
            starts.append(size + at - done)
        held.append(batch.slice(done))
        size += len(batch) - done
    if size:
        yield compare(pa.Table.from_batches(held), [*starts, size])


def across(rows: pa.Table) -> np.ndarray | None:
    """The parts of a group that compares two blocks, None for a block with itself."""
    if rows["i"][0].as_py() == rows["j"][0].as_py():
        return None
    return rows["part"].to_numpy()

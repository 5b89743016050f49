"""Exact links of vectors that crowd around a few directions.

Where many vectors that do not link stand close together, sorted passes need very many signs to part
them. Here a crowd is a ball around a pivot: every vector within the ball's angle (its core) is
compared with every vector that could link with a core vector, which by the triangle inequality lies
within the ball's angle plus that of the threshold (its rim). Rim vectors are not compared with each
other. The rest of the table is not touched.

``plan`` decides from a sample which vectors a ball pays for: passes over all rows and comparisons
inside balls are both counted as comparisons, and the cheapest mix is taken, with no fewer passes
than spread rows need. A crowd that costs more than its passes keeps them, so no case is left out.

How it runs: blocks of at most ``ROWS`` vectors, one shuffle of every vector to the pairs of blocks it
belongs to, two blocks in a task's memory at a time. A block pair emits the links that join parts
that its task has not joined before, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulens.session import pin, small_table

from .graph import Forest

ROWS = 4096
TILE = 512
BALLS = 32
MARGIN = 0.05
PASS_COST = 512
GROUPS = 4096


@dataclass(frozen=True)
class Ball:
    """Vectors of a length within ``angle`` of a unit ``pivot``."""

    length: int
    pivot: np.ndarray
    angle: float


def cover(unit: np.ndarray, wanted: np.ndarray) -> list[Ball] | None:
    """Balls that hold all wanted sample vectors, the most crowded first; None if it takes too many."""
    balls: list[Ball] = []
    left = unit[wanted]
    close = left @ left.T >= 0.5
    while len(left):
        counts = close.sum(axis=1)
        # a later ball holds no more than this one
        if counts.max() * (BALLS - len(balls)) < len(left):
            return None
        own = close[counts.argmax()]
        pivot = left[own].mean(axis=0)
        pivot /= np.linalg.norm(pivot)
        widest = float(np.arccos(np.clip(left[own] @ pivot, -1.0, 1.0)).max())
        balls.append(Ball(unit.shape[1], pivot, widest + MARGIN))
        left, close = left[~own], close[np.ix_(~own, ~own)]
    return balls


def comparisons(unit: np.ndarray, rows: int, balls: list[Ball], threshold: float) -> float:
    """Comparisons that the balls take among ``rows`` vectors, by a sample."""
    share, total = rows / len(unit), 0.0
    for ball in balls:
        cosine = unit @ ball.pivot
        core = float((cosine >= math.cos(ball.angle)).sum()) * share
        reached = float((cosine >= math.cos(_reach(ball, threshold))).sum()) * share
        total += core * (reached - core / 2)
    return total


def plan(
    unit: np.ndarray, needed: np.ndarray, rows: int, least: int, threshold: float
) -> tuple[float, int, list[Ball]]:
    """(cost, passes, balls) that together meet what each sample vector needs, at the least cost."""
    passes = max(least, int(needed.max()))
    best: tuple[float, int, list[Ball]] = (float(passes) * rows * PASS_COST, passes, [])
    limit = least
    while limit < passes:
        balls = cover(unit, needed > limit)
        if balls:
            cost = float(limit) * rows * PASS_COST + comparisons(unit, rows, balls, threshold)
            if cost < best[0]:
                best = (cost, limit, balls)
        limit = math.ceil(limit * 1.5)
    return best


def _reach(ball: Ball, threshold: float) -> float:
    return min(math.pi, ball.angle + math.acos(threshold) + 1e-9)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _members(
    batches: Iterator[pa.RecordBatch], balls: list[Ball], threshold: float
) -> Iterator[pa.RecordBatch]:
    """(ball, core, node, vector) of each vector and ball that it can have a link in."""
    for batch in batches:
        lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            part = batch.filter(pa.array(lengths == length))
            unit = unit_rows(part.column("vector"))
            for number, ball in enumerate(balls):
                if ball.length != length:
                    continue
                cosine = unit @ ball.pivot
                inside = cosine >= math.cos(_reach(ball, threshold))
                held = part.filter(pa.array(inside))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(held), number, np.int32)),
                        pa.array((cosine >= math.cos(ball.angle))[inside]),
                        held.column("node"),
                        held.column("vector"),
                    ],
                    names=["ball", "core", "node", "vector"],
                )


def _join_near(near: np.ndarray, a: np.ndarray, b: np.ndarray, forest: Forest) -> list[dict]:
    """Links that join what ``near`` ties and the forest does not yet: (row of a, row of b)."""
    rows, cols = near.any(axis=1).nonzero()[0], near.any(axis=0).nonzero()[0]
    if not len(rows):
        return []
    near, a, b = near[np.ix_(rows, cols)], a[rows].tolist(), b[cols].tolist()
    found: list[dict] = []
    while True:
        part_a = np.array([forest.find(x) for x in a])
        part_b = np.array([forest.find(x) for x in b])
        apart = near & (part_a[:, None] != part_b[None, :])
        some_a, some_b = apart.any(axis=1).nonzero()[0], apart.any(axis=0).nonzero()[0]
        if not len(some_a):
            return found
        pairs = [
            *zip(some_a.tolist(), apart[some_a].argmax(axis=1).tolist(), strict=True),
            *zip(apart[:, some_b].argmax(axis=0).tolist(), some_b.tolist(), strict=True),
        ]
        found += [{"a": a[i], "b": b[j]} for i, j in pairs if forest.join(a[i], b[j])]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between the two blocks of each group, or within its only one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    forest, held, key = Forest(), [], None

    def joined() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        unit, node, block = unit_rows(rows["vector"]), rows["node"].to_numpy(), rows["block"].to_numpy()
        one, other = block == key[1], block == key[2]
        found: list[dict] = []
        mine, theirs = node[one], node[other]
        across = unit[other].T
        for at in range(0, len(mine), TILE):
            near = unit[one][at : at + TILE] @ across >= threshold
            if key[1] == key[2]:
                near &= mine[at : at + TILE, None] < theirs[None, :]
            found += _join_near(near, mine[at : at + TILE], theirs, forest)
        return pa.RecordBatch.from_pylist(found, schema)

    for batch in batches:
        keys = np.stack(
            [batch.column(k).to_numpy(zero_copy_only=False) for k in ("ball", "i", "j")], axis=1
        )
        cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1), len(keys)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if stop == start:
                continue
            if key is not None and key != tuple(keys[start]):
                yield joined()
                held = []
            key = tuple(keys[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield joined()


def crowd_links(
    classes: DataFrame, balls: list[Ball], threshold: float, block: int = ROWS
) -> DataFrame:
    """(a, b): links that together join all vectors that link with a core vector of any ball.

    ``classes`` holds (node, vector), one row per distinct vector.
    """
    if not balls:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    members = pin(
        classes.select("node", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
            lambda batches: _members(batches, balls, threshold),
            "ball int, core boolean, node long, vector array<double>",
        )
    )
    return _member_links(members, threshold, block)


def core_nodes(classes: DataFrame, balls: list[Ball], threshold: float) -> DataFrame:
    """(node) of the core vectors of all balls."""
    members = classes.select("node", F.col("vector").cast("array<double>").alias("vector"))
    return (
        members.mapInArrow(
            lambda batches: _members(batches, balls, threshold),
            "ball int, core boolean, node long, vector array<double>",
        )
        .where("core")
        .select("node")
        .distinct()
    )


def links_with_all(
    classes: DataFrame, some: DataFrame, threshold: float, block: int = ROWS
) -> DataFrame:
    """(a, b): links that together join each vector of ``some`` (node) with all that it links with.

    Each is compared with every vector of its length.
    """
    members = classes.join(some.select("node", F.lit(True).alias("core")), "node", "left").select(
        F.size("vector").alias("ball"), F.coalesce("core", F.lit(False)).alias("core"), "node", "vector"
    )
    return _member_links(members, threshold, block)


def _member_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links of core vectors with all others of their ball, from (ball, core, node, vector)."""
    spark = members.sparkSession
    counted = members.groupBy("ball").agg(
        F.count_if("core").alias("core"), F.count_if(~F.col("core")).alias("rim")
    )
    sizes = [
        (r.ball, -(-r.core // block), -(-r.rim // block)) for r in counted.collect() if r.core
    ]
    groups = sum(c * (c + 1) // 2 + c * rim for _, c, rim in sizes)
    if not groups:
        return spark.createDataFrame([], "a long, b long")
    parts = small_table(spark, sizes, "ball int, cores int, rims int")
    core, place = F.col("core"), F.xxhash64("node")
    pairs = (
        members.join(F.broadcast(parts), "ball")
        .withColumn(
            "block",
            F.when(core, F.pmod(place, "cores"))
            .otherwise(F.col("cores") + F.pmod(place, F.greatest("rims", F.lit(1))))
            .cast("int"),
        )
        .withColumn(
            "other",
            F.explode(
                F.sequence(F.lit(0), F.col("cores") - 1 + F.when(core, F.col("rims")).otherwise(0))
            ),
        )
        .select(
            "ball", "node", "vector", "block",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )
    # a stated number of partitions: few bytes here are much work
    return (
        pairs.repartition(min(groups, GROUPS), "ball", "i", "j")
        .sortWithinPartitions("ball", "i", "j")
        .mapInArrow(lambda batches: _compare(batches, threshold), "a long, b long")
        .distinct()
    )

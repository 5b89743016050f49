"""Gaussian density curves on an even grid, alone or per group."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulens.session import small_table

GRID_POINTS = 60
_SUMS = pa.schema(
    [("number", pa.int32()), ("point", pa.int32()), ("x", pa.float64()), ("total", pa.float64())]
)


def grid(low: float, high: float) -> list[float]:
    return [low + i / (GRID_POINTS - 1) * (high - low) for i in range(GRID_POINTS)]


def density(
    values: DataFrame, groups: Sequence[tuple[str, float, float, float, int]]
) -> DataFrame:
    """(grp, point, x, density) with 60 points per group from its minimum to its maximum.

    ``groups`` lists (grp, min, max, sample std, n) of at most a dozen groups; ``values``
    holds (grp, value). A task adds the different numbers of a batch to the 60 sums of their group
    as one matrix, and sends 60 short rows per group. Groups with fewer than two rows or no spread
    have no curve.
    """
    usable = [
        (number, name, n, std * n ** (-1 / 5), grid(low, high))
        for number, (name, low, high, std, n) in enumerate(groups)
        if n > 1 and std
    ]
    table = small_table(
        values.sparkSession,
        [row[:4] for row in usable],
        "number int, grp string, size bigint, width double",
    )
    curves = {number: (width, np.array(points)) for number, _, _, width, points in usable}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            where, cells = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for number in np.unique(where).tolist():
                width, points = curves[number]
                # equal numbers of a batch have the same bumps
                seen, n = np.unique(cells[where == number], return_counts=True)
                z = (points - seen[:, None]) / width
                total = totals.setdefault(number, np.zeros(GRID_POINTS))
                total += n @ np.exp(-0.5 * z * z)
        rows = [
            {"number": number, "point": i, "x": float(curves[number][1][i]), "total": float(t)}
            for number, total in totals.items()
            for i, t in enumerate(total)
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=_SUMS)

    numbered = values.where(F.col("value").isNotNull()).join(F.broadcast(table), "grp")
    kernels = (
        numbered.select("number", F.col("value").cast("double"))
        .mapInArrow(add_up, "number int, point int, x double, total double")
        .groupBy("number", "point", "x")
        .agg(F.sum("total").alias("total"))
    )
    scale = F.col("size") * F.col("width") * F.lit(math.sqrt(2 * math.pi))
    return kernels.join(F.broadcast(table), "number").select(
        "grp", "point", "x", (F.col("total") / scale).alias("density")
    )

"""Equal-width histograms, binned entropy and outlier counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the histogram rules.
ENTROPY_BINS = 20
FEWEST_BINS, MOST_BINS, MOST_STURGES_BINS = 5, 60, 50


def bin_count(n: int, low: float, high: float, iqr: float) -> int:
    """Number of bins: width 2 * IQR / cube root of n, by the logarithm of n if IQR is 0."""
    if iqr > 0:
        width = 2 * iqr * n ** (-1 / 3)
        return max(FEWEST_BINS, min(MOST_BINS, math.ceil((high - low) / width)))
    return max(FEWEST_BINS, min(MOST_STURGES_BINS, math.ceil(math.log2(n) + 1)))


def bin_range(low: float, high: float) -> tuple[float, float]:
    """A constant column gets a range of one around its value."""
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def label_digits(span: float) -> int:
    for limit, digits in ((100, 0), (10, 1), (1, 2)):
        if span > limit:
            return digits
    return 3


def edge(index: Column, low: Column, high: Column, k: Column) -> Column:
    """Left edge of a bin; the edge after the last bin is exactly ``high``."""
    return F.when(index >= k, high).otherwise(low + index * ((high - low) / k))


def bin_index(value: Column, low: Column, high: Column, k: Column) -> Column:
    """Bin of a value, 0 to k - 1. Bins are closed on the left, the last one on both sides.

    The quotient can be off by one next to an edge, so the edges decide.
    """
    guess = F.least(F.floor((value - low) * (k / (high - low))), k - 1)
    return (
        F.when(value < edge(guess, low, high, k), guess - 1)
        .when((value >= edge(guess + 1, low, high, k)) & (guess < k - 1), guess + 1)
        .otherwise(guess)
        .cast("int")
    )


def histogram(values: DataFrame, low: float, high: float, k: int) -> DataFrame:
    """(bin, lo, hi, label, n) for the column ``value``; empty bins are kept."""
    low, high = bin_range(low, high)
    lo, hi, bins = F.lit(low), F.lit(high), F.lit(k)
    counts = (
        values.groupBy(bin_index(F.col("value"), lo, hi, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    digits = label_digits(high - low)
    every = values.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    left = edge(F.col("bin"), lo, hi, bins)
    right = edge(F.col("bin") + 1, lo, hi, bins)

    def text(bound: Column) -> Column:
        # one decimal is always shown, as for any real number
        shown = F.round(bound, digits).cast(f"decimal(38,{max(1, digits)})").cast("string")
        return F.regexp_replace(shown, r"(\.\d+?)0+$", "$1")

    return (
        every.join(F.broadcast(counts), "bin", "left")  # at most 60 rows on either side
        .select(
            "bin",
            left.alias("lo"),
            right.alias("hi"),
            F.concat(text(left), F.lit("–"), text(right)).alias("label"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


@dataclass(frozen=True)
class Scale:
    """The bins of one column and where its outliers begin."""

    edges: np.ndarray
    fences: tuple[float, float]
    mean: float
    std: float

    @classmethod
    def of(cls, m: Mapping[str, float]) -> Scale:
        low, high = bin_range(m["min"], m["max"])
        reach = 1.5 * (m["q3"] - m["q1"])
        k = min(ENTROPY_BINS, m["n_valid"])
        inner = low + np.arange(1, k) * ((high - low) / k)
        return cls(inner, (m["q1"] - reach, m["q3"] + reach), float(m["mean"]), m["std"])

    def count(self, v: np.ndarray) -> np.ndarray:
        """(bin, 3): rows, rows beyond the fences, rows beyond three deviations."""
        place = np.searchsorted(self.edges, v, side="right")
        outside = (v < self.fences[0]) | (v > self.fences[1])
        # a spread of zero leaves no z-score, hence no outlier
        far = np.abs(v - self.mean) / self.std > 3 if self.std else np.zeros(len(v), bool)
        bins = len(self.edges) + 1
        kinds = (np.bincount(place[kept], minlength=bins) for kept in (slice(None), outside, far))
        return np.stack(list(kinds), axis=1)


def _spread(
    rows: DataFrame,
    cells: Callable[[pa.RecordBatch], Iterable[tuple[int, np.ndarray]]],
    params: Mapping[int, Mapping[str, float]],
) -> DataFrame:
    """Outlier counts and binned entropy from the (position, values) that batches hold.

    A task counts at most 20 bins per column and sends only these.
    """
    scales = {pos: Scale.of(m) for pos, m in params.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {pos: np.zeros((len(s.edges) + 1, 3), np.int64) for pos, s in scales.items()}
        for batch in batches:
            for pos, values in cells(batch):
                totals[pos] += scales[pos].count(values)
        for pos, total in totals.items():
            bins = np.nonzero(total[:, 0])[0]
            where = [np.full(len(bins), pos, np.int32), bins.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (*where, *total[bins].T)],
                names=["pos", "bin", "n", "outside", "far"],
            )

    counted = rows.mapInArrow(count, "pos int, bin int, n long, outside long, far long")
    per_bin = counted.groupBy("pos", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "outside", "far")])
    # sum(n log2 n) gives the entropy without a second look at the total
    n = F.col("n").cast("double")
    total = F.sum(n)
    return per_bin.groupBy("pos").agg(
        F.sum("outside").alias("outliers_iqr"),
        F.sum("far").alias("outliers_z"),
        (F.log2(total) - F.sum(n * F.log2(n)) / total).alias("numeric_entropy"),
    )


def column_spread(
    df: DataFrame, values: Mapping[int, Column], params: Mapping[int, Mapping[str, float]]
) -> DataFrame:
    """Outlier counts and binned entropy of columns side by side, in one pass.

    ``params`` holds min, max, mean, std, q1, q3 and n_valid of each position.
    """
    wide = df.select(*[expr.cast("double").alias(str(pos)) for pos, expr in values.items()])
    positions = list(values)

    def cells(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for i, pos in enumerate(positions):
            yield pos, batch.column(i).drop_null().to_numpy(zero_copy_only=False)

    return _spread(wide, cells, params)


def spread_metrics(long: DataFrame, params: Mapping[int, Mapping[str, float]]) -> DataFrame:
    """The same from rows (pos, value)."""
    rows = long.where(F.col("value").isNotNull()).select("pos", F.col("value").cast("double"))
    known = set(params)

    def cells(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        where, values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for pos in known.intersection(np.unique(where).tolist()):
            yield pos, values[where == pos]

    return _spread(rows, cells, params)


def discrete_histogram(values: DataFrame) -> DataFrame:
    """(label, n) with one row per value; used for at most 30 integers."""
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(
        "value", F.col("value").cast("long").cast("string").alias("label"), "n"
    )

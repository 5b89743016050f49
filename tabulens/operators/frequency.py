"""Value counts and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulens.functions.text import named
from tabulens.session import pin

# Texts longer than this are told apart by a 128-bit digest, so that counting distinct
# documents shuffles 16 bytes per value instead of the document.
DIGEST_OVER = 32


def to_long(df: DataFrame, values: Mapping[int, Column], name: str = "value") -> DataFrame:
    """One row per (position, non-null value). ``values`` maps a position to an expression."""
    wide = df.select(*[expr.alias(f"c{pos}") for pos, expr in values.items()])
    cells = [part for pos in values for part in (F.lit(pos), F.col(f"c{pos}"))]
    long = wide.select(F.stack(F.lit(len(values)), *cells).alias("pos", name))
    return long.where(F.col(name).isNotNull())


def value_counts(df: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """Distinct key combinations with their number of rows ``n``.

    Counts are combined on the map side, so a value that fills a third of the table
    costs one row per task in the shuffle.
    """
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys).agg(counted.alias("n"))


# values that a task gathers per column before it merges equal ones
GATHERED = 1 << 16


def number_counts(df: DataFrame, values: Mapping[int, Column]) -> DataFrame:
    """(pos, value, n) of the numbers of many columns, cells never lined up one by one.

    Tasks sort what they gather and merge equal numbers; a column that keeps many different
    ones is sent on in pieces, so that a task holds at most twice ``GATHERED`` per column.
    """
    wide = df.select(*[expr.cast("double").alias(str(pos)) for pos, expr in values.items()])
    positions = list(values)

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        seen, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        weights = np.concatenate([n for _, n in parts])
        # counts stay far below 2 ** 53, where sums of doubles are exact
        return seen, np.bincount(place, weights, len(seen)).astype(np.int64)

    def rows(pos: int, counted: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        seen, n = counted
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(seen), pos, np.int32)), pa.array(seen), pa.array(n)],
            names=["pos", "value", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {pos: [] for pos in positions}
        size = dict.fromkeys(positions, 0)
        for batch in batches:
            for i, pos in enumerate(positions):
                # 0.0 is added so that -0.0 equals 0.0
                own = batch.column(i).drop_null().to_numpy(zero_copy_only=False) + 0.0
                held[pos].append((own, np.ones(len(own), np.int64)))
                size[pos] += len(own)
                if size[pos] < GATHERED:
                    continue
                held[pos] = [merge(held[pos])]
                size[pos] = len(held[pos][0][0])
                if size[pos] > GATHERED // 2:
                    yield rows(pos, held[pos][0])
                    held[pos], size[pos] = [], 0
        for pos in positions:
            if size[pos]:
                yield rows(pos, merge(held[pos]))

    parts = wide.mapInArrow(count, "pos int, value double, n long")
    return value_counts(parts, "pos", "value", weight="n")


def text_key(text: Column, longest: int) -> Column:
    """What identifies a text: itself while short, else its digest."""
    return F.unhex(F.md5(text)) if longest > DIGEST_OVER else text.cast("binary")


def distinct_counts(long: DataFrame) -> DataFrame:
    """Number of distinct values per position."""
    return value_counts(long, "pos", "value").groupBy("pos").agg(
        F.count(F.lit(1)).alias("n_unique")
    )


def mode_metrics() -> list[Column]:
    """Aggregates over (value, n): distinct values and mode.

    The mode is the smallest of the most frequent values, and NULL if none repeats.
    """
    most = F.max_by("value", F.struct(F.col("n"), -F.col("value")))
    return [
        F.count(F.lit(1)).alias("n_unique_vals"),
        F.when(F.max("n") > 1, most).alias("mode"),
    ]


def ranked(counts: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Add ``rank`` (from 1) per ``by``: count descending, then value ascending.

    Meant for counts with a bounded number of values per key.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc(value))
    return counts.withColumn("rank", F.row_number().over(order))


def top_k(counts: DataFrame, k: int, value: str = "value") -> DataFrame:
    """The ``k`` most frequent values; each task keeps only its own best ``k``."""
    return counts.orderBy(F.desc("n"), F.asc(value)).limit(k)


def category_metrics(counts: DataFrame) -> DataFrame:
    """Entropy, balance, dominance and top values per position.

    ``counts`` holds (pos, value, n) of categorical columns, which have at most 100 values
    each by definition, so one position fits a single task with ease.
    """
    per_column = Window.partitionBy("pos")
    p = F.col("n") / F.col("n_valid")
    shares = (
        ranked(counts, ["pos"])
        .withColumn("n_valid", F.sum("n").over(per_column))
        .withColumn("p", p)
    )
    first = F.col("rank") <= 10
    tops = F.sort_array(F.collect_list(F.when(first, F.struct("rank", "value", "n", "p"))))
    return (
        shares.groupBy("pos")
        .agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.first("n_valid").alias("n_valid"),
            (-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("categorical_entropy"),
            (1 - F.sum(F.col("p") * F.col("p"))).alias("gini_impurity"),
            tops.alias("tops"),
        )
        .select(
            "pos",
            "unique_count",
            "n_valid",
            (F.col("unique_count") / F.col("n_valid")).alias("cardinality_ratio"),
            F.col("tops")[0]["value"].alias("dominant_value"),
            (F.col("tops")[0]["p"] * 100).alias("dominant_rate"),
            (1 - F.col("tops")[0]["p"]).alias("balance_score"),
            "categorical_entropy",
            (
                F.col("categorical_entropy")
                / F.when(F.col("unique_count") > 1, F.log2("unique_count")).otherwise(1.0)
            ).alias("normalised_entropy"),
            "gini_impurity",
            F.col("tops.value").alias("top_values"),
            F.col("tops.n").alias("top_counts"),
            F.transform("tops.p", lambda share: F.round(share * 100, 2)).alias("top_pcts"),
        )
    )


# Up to so many distinct values their counts are sent to every task.
BROADCAST_VALUES = 10_000


def frequency_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the number of rows that share the row's value; NULL stays NULL.

    The counts are broadcast when there are few values, as a categorical column has; otherwise
    they are joined by a shuffle.
    """
    key = "_value"
    while key in df.columns or key == name:
        key += "_"
    counts = value_counts(df.select(named(column).alias("value")).dropna(), "value")
    lookup = pin(counts.select(F.col("value").alias(key), F.col("n").alias(name)))
    if lookup.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        lookup = F.broadcast(lookup)
    return df.join(lookup, named(column) == F.col(key), "left").drop(key)

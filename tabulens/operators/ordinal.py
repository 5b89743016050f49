"""Row positions and order-dependent checks without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabulens.functions.text import named
from tabulens.session import pin, small_table

# monotonically_increasing_id: the partition sits above bit 33, the row number below
ROW_BITS = 33
SALT_SEED = 7


def order_keys(order_by: Sequence[str]) -> list[Column]:
    """The order columns under names that clash with no other column."""
    return [named(name).alias(key) for name, key in zip(order_by, key_names(order_by))]


def key_names(order_by: Sequence[str]) -> list[str]:
    return [f"_key{i}" for i, _ in enumerate(order_by)]


def in_order(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Range-partition by the order columns and sort inside each partition.

    A seeded random last key lets the partitions split rows with equal order columns, so a
    value shared by a third of the rows does not end up in one task.
    """
    if not order_by:
        return df
    keys = [named(key) if isinstance(key, str) else key for key in order_by]
    salted = df.withColumn("_salt", F.rand(SALT_SEED))
    return salted.repartitionByRange(*keys, "_salt").drop("_salt").sortWithinPartitions(*keys)


def with_ordinal(
    df: DataFrame, order_by: Sequence[str | Column] = (), name: str = "_rid"
) -> DataFrame:
    """Number the rows from 0 in the given order (without one: in the order they are read).

    One range shuffle sorts the rows; each partition numbers its own and starts after the
    rows of the partitions before it. Only one count per partition is broadcast. The rows
    are pinned in between, so that a retried task cannot see another split. Order columns
    should identify a row: ties get positions in no particular order.
    """
    placed = pin(in_order(df, order_by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS)
    counts = {
        row["part"]: row["n"]
        for row in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    starts, total = [], 0
    for number in sorted(counts):
        starts.append((number, total))
        total += counts[number]
    offsets = small_table(df.sparkSession, starts, "_part bigint, _start bigint")
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + inside)
        .drop("_part", "_start", "_at")
    )


def every_nth(numbered: DataFrame, rows: int, points: int, name: str = "_rid") -> DataFrame:
    """Every k-th row, k chosen to leave about ``points`` of ``rows``."""
    step = max(1, rows // points)
    return numbered.where(F.col(name) % step == 0)


def is_row_number(numbered: DataFrame, value: Column, name: str = "_rid") -> DataFrame:
    """One row telling whether ``value`` equals the row position everywhere."""
    same = value.eqNullSafe(F.col(name).cast("double"))
    return numbered.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("is_row_number"))


_RUN_SCHEMA = "part int, pos int, first long, last long, rising boolean, falling boolean"
_RUN_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("pos", pa.int32()),
        ("first", pa.int64()),
        ("last", pa.int64()),
        ("rising", pa.bool_()),
        ("falling", pa.bool_()),
    ]
)
# partitions that one step of the reduction joins
RUNS = 1024


def order_words(column: pa.Array) -> np.ndarray:
    """Longs in the order of the non-null values: numbers as doubles, timestamps in their own unit."""
    seen = column.drop_null()
    if pa.types.is_timestamp(seen.type):
        return seen.cast(pa.int64()).to_numpy(zero_copy_only=False)
    # the bits of a double are ordered but for the sign; 0.0 is added so that -0.0 equals 0.0
    bits = (seen.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def monotonic_runs(ordered: DataFrame, values: Mapping[int, Column]) -> DataFrame:
    """One row per partition and column: end values and whether it rises or falls throughout.

    A partition is read once, in batches, and only the last value is carried along; the
    table is not shuffled again after it has been sorted. End values are order words.
    """
    wide = ordered.select(*[expr.alias(str(pos)) for pos, expr in values.items()])
    positions = list(values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list] = {}
        for batch in batches:
            for index, pos in enumerate(positions):
                words = order_words(batch.column(index))
                if not len(words):
                    continue
                run = runs.setdefault(pos, [words[0], words[0], True, True])
                before = np.concatenate([[run[1]], words[:-1]])
                run[1] = words[-1]
                run[2] = run[2] and bool((words >= before).all())
                run[3] = run[3] and bool((words <= before).all())
        if runs:
            part = TaskContext.get().partitionId()
            rows = [
                {
                    "part": part,
                    "pos": pos,
                    "first": int(first),
                    "last": int(last),
                    "rising": rising,
                    "falling": falling,
                }
                for pos, (first, last, rising, falling) in runs.items()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_RUN_ARROW)

    return wide.mapInArrow(scan, _RUN_SCHEMA)


def join_runs(runs: DataFrame, size: int = RUNS) -> DataFrame:
    """Runs of ``size`` neighbouring partitions as one run each, numbered by their place.

    Joining two runs is associative: the ends are the outer ones, and the whole rises if both
    parts do and the second starts no lower than the first ended.
    """
    run = F.struct("part", "first", "last", "rising", "falling")

    def joined(left: Column, right: Column) -> Column:
        return F.struct(
            right["part"].alias("part"),
            left["first"].alias("first"),
            right["last"].alias("last"),
            (left["rising"] & right["rising"] & (left["last"] <= right["first"])).alias("rising"),
            (left["falling"] & right["falling"] & (left["last"] >= right["first"])).alias("falling"),
        )

    gathered = runs.groupBy("pos", F.floor(F.col("part") / size).cast("int").alias("place")).agg(
        F.array_sort(F.collect_list(run)).alias("runs")
    )
    whole = F.aggregate(F.slice("runs", 2, size), F.element_at("runs", 1), joined)
    return gathered.select("pos", "place", whole.alias("run")).select(
        F.col("place").alias("part"), "pos", "run.first", "run.last", "run.rising", "run.falling"
    )


def monotonic_flags(
    df: DataFrame, values: Mapping[int, Column], order_by: Sequence[str | Column] = ()
) -> dict[int, tuple[bool, bool]]:
    """Whether each column's non-null values never fall, and never rise, in row order.

    Values are numbers or timestamps. The runs of the partitions are joined in two steps on the
    executors, at most ``RUNS`` by one task at a time for up to ``RUNS`` squared partitions; the
    driver sees one row per column.
    """
    runs = monotonic_runs(in_order(df, order_by), values)
    whole = join_runs(join_runs(runs), 1 << 30)
    return {row["pos"]: (row["rising"], row["falling"]) for row in whole.collect()}

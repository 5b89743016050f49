"""Exact quantiles (linear interpolation) that never gather a whole column in one task.

Groups up to ``DIRECT_ROWS`` rows are counted per value, and a running count gives the
ranks. Larger ones are narrowed first: a sketch proposes edges around the wanted ranks, each row
finds its place between the sorted edges by one binary search, the counts between the edges say
where the ranks are, and this repeats until such a gap is small enough to be sorted. Only sketches
and counts are shuffled then; the column itself is not, and no row is copied for a rank. Columns of
a table are read side by side in Arrow batches, their cells never lined up one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulens.operators.frequency import value_counts
from tabulens.session import small_table

DIRECT_ROWS = 1_000_000
GRID = 1024
INFINITY = float("inf")
SKETCH_ACCURACY = 10_000
# A task sorts the rows of a bracket in pieces of this many, and of a large bracket sends every
# THIN-th on to the sketch: ranks are then off by 1 / 1024 at most, as they are between grid points.
PIECE, THIN = 1 << 16, 64


@dataclass(frozen=True)
class Bracket:
    """The ``inside`` rows strictly between ``low`` and ``high``; ``before`` rows come first."""

    pos: int
    low: float
    high: float
    before: int
    inside: int
    ranks: tuple[int, ...]


@dataclass(frozen=True)
class Cells:
    """Rows, and how the values of each position are read from a batch of some of its columns."""

    rows: Callable[[Sequence[int]], DataFrame]
    read: Callable[[Sequence[int], pa.RecordBatch], Iterable[tuple[int, np.ndarray]]]


def long_cells(long: DataFrame) -> Cells:
    """Rows (pos, value)."""

    def rows(positions: Sequence[int]) -> DataFrame:
        own = long.where(F.col("pos").isin(list(positions)))
        return own.select("pos", F.col("value").cast("double"))

    def read(
        positions: Sequence[int], batch: pa.RecordBatch
    ) -> Iterator[tuple[int, np.ndarray]]:
        where, values = _columns(batch)
        for pos in positions:
            yield pos, values[where == pos]

    return Cells(rows, read)


def column_cells(df: DataFrame, values: Mapping[int, Column]) -> Cells:
    """Columns side by side; NULL is no value."""

    def rows(positions: Sequence[int]) -> DataFrame:
        return df.select(*[values[pos].cast("double").alias(str(pos)) for pos in positions])

    def read(
        positions: Sequence[int], batch: pa.RecordBatch
    ) -> Iterator[tuple[int, np.ndarray]]:
        for i, pos in enumerate(positions):
            yield pos, batch.column(i).drop_null().to_numpy(zero_copy_only=False)

    return Cells(rows, read)


def exact_quantiles(
    long: DataFrame,
    probabilities: Sequence[float],
    sizes: Mapping[int, int],
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Quantiles ``q`` (in the order of ``probabilities``) per position.

    ``long`` holds (pos, value) and ``sizes`` the number of rows of each position, which
    callers know from an earlier pass. Positions are columns or a short list of groups.
    """
    small = {pos: n for pos, n in sizes.items() if 0 < n <= direct_rows}
    large = {pos: n for pos, n in sizes.items() if n > direct_rows}
    chosen = long.where(F.col("pos").isin(list(small))) if large else long
    direct = (
        running_counts(value_counts(chosen, "pos", "value"), small)
        .groupBy("pos")
        .agg(quantile_array(probabilities).alias("q"))
    )
    if not large:
        return direct
    rows = _narrowed(long_cells(long), probabilities, large, direct_rows).items()
    narrowed = small_table(long.sparkSession, rows, "pos int, q array<double>")
    return narrowed if not small else direct.unionByName(narrowed)


def column_quantiles(
    df: DataFrame,
    values: Mapping[int, Column],
    probabilities: Sequence[float],
    sizes: Mapping[int, int],
    direct_rows: int = DIRECT_ROWS,
) -> dict[int, list[float]]:
    """Quantiles of columns by position, however many rows each has; ``sizes`` as above."""
    return _narrowed(column_cells(df, values), probabilities, sizes, direct_rows)


def _narrowed(
    cells: Cells, probabilities: Sequence[float], sizes: Mapping[int, int], direct_rows: int
) -> dict[int, list[float]]:
    at_rank = _values_at_ranks(cells, _ranks(probabilities, sizes), sizes, direct_rows)
    out: dict[int, list[float]] = {}
    for pos, n in sizes.items():
        for p in probabilities:
            place = p * (n - 1)
            lower = at_rank[pos, math.floor(place)]
            upper = at_rank[pos, math.ceil(place)]
            quantile = lower + (upper - lower) * (place - math.floor(place))
            out.setdefault(pos, []).append(quantile)
    return out


def running_counts(counts: DataFrame, sizes: Mapping[int, int]) -> DataFrame:
    """Add ``end`` (rows up to and including the value) and ``size`` to (pos, value, n)."""
    table = small_table(counts.sparkSession, sizes.items(), "pos int, size bigint")
    order = Window.partitionBy("pos").orderBy("value")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.join(F.broadcast(table), "pos").withColumn("end", F.sum("n").over(upto))


def quantile_array(probabilities: Sequence[float]) -> Column:
    """Aggregate over running counts: the interpolated quantiles of a group."""

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("end") > rank, F.col("value")))

    quantiles = []
    for p in probabilities:
        place = F.lit(float(p)) * (F.col("size") - 1)
        lower, upper = at_rank(F.floor(place)), at_rank(F.ceil(place))
        fraction = F.max(place - F.floor(place))
        quantiles.append(lower + (upper - lower) * fraction)
    return F.array(*quantiles)


def _ranks(
    probabilities: Sequence[float], sizes: Mapping[int, int]
) -> dict[int, tuple[int, ...]]:
    return {
        pos: tuple(
            sorted({edge(p * (n - 1)) for p in probabilities for edge in (math.floor, math.ceil)})
        )
        for pos, n in sizes.items()
    }


def values_at_ranks(
    long: DataFrame,
    ranks: Mapping[int, Sequence[int]],
    sizes: Mapping[int, int],
    direct_rows: int = DIRECT_ROWS,
) -> dict[tuple[int, int], float]:
    """The values at the given 0-based ranks of each position's sorted rows (pos, value)."""
    return _values_at_ranks(long_cells(long), ranks, sizes, direct_rows)


def _values_at_ranks(
    cells: Cells,
    ranks: Mapping[int, Sequence[int]],
    sizes: Mapping[int, int],
    direct_rows: int,
) -> dict[tuple[int, int], float]:
    brackets = [
        Bracket(pos, -INFINITY, INFINITY, 0, sizes[pos], tuple(ranks[pos])) for pos in ranks
    ]
    found: dict[tuple[int, int], float] = {}
    while any(b.inside > direct_rows for b in brackets):
        wide = [b for b in brackets if b.inside > direct_rows]
        done = [b for b in brackets if b.inside <= direct_rows]
        brackets = done + _confirm(cells, _propose(cells, wide), wide, found)
    found.update(_read(cells, brackets))
    return found


def _by_position(brackets: Sequence[Bracket]) -> dict[int, list[tuple[float, float, int]]]:
    """(low, high, number) of the brackets of each position, in order; they do not overlap."""
    out: dict[int, list[tuple[float, float, int]]] = {}
    for number, b in enumerate(brackets):
        out.setdefault(b.pos, []).append((b.low, b.high, number))
    return {pos: sorted(own) for pos, own in out.items()}


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "value"))


def _inside(
    brackets: Sequence[Bracket], cells: Cells
) -> Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Reader of a batch: (brackets, values) inside them, each found by one binary search."""
    own = {
        pos: tuple(np.array(x) for x in zip(*sorted_own, strict=True))
        for pos, sorted_own in _by_position(brackets).items()
    }
    read = cells.read

    def inside(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for pos, v in read(list(own), batch):
            lows, highs, numbers = own[pos]
            at = np.searchsorted(lows, v, side="left") - 1
            kept = (at >= 0) & (v < highs[at])
            yield numbers[at[kept]].astype(np.int32), v[kept]

    return inside


def _tagged(cells: Cells, brackets: Sequence[Bracket]) -> DataFrame:
    """(bracket, value) of the rows inside a bracket."""
    inside = _inside(brackets, cells)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, values in inside(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), pa.array(values)], names=["bracket", "value"]
                )

    rows = cells.rows(list(_by_position(brackets)))
    return rows.mapInArrow(tag, "bracket int, value double")


def _thinned(cells: Cells, brackets: Sequence[Bracket]) -> DataFrame:
    """(bracket, value) of the rows inside a bracket, evenly thinned in large ones."""
    inside = _inside(brackets, cells)
    steps = [max(1, min(THIN, b.inside // PIECE)) for b in brackets]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}

        def piece(number: int) -> pa.RecordBatch:
            step = steps[number]
            values = np.concatenate(held.pop(number))
            # a piece shorter than a step still sends one value
            first = min(step // 2, (len(values) - 1) // 2)
            values = np.sort(values)[first::step] if step > 1 else values
            del size[number]
            where = pa.array(np.full(len(values), number, np.int32))
            return pa.RecordBatch.from_arrays([where, pa.array(values)], names=["bracket", "value"])

        for batch in batches:
            for numbers, values in inside(batch):
                for number in np.unique(numbers).tolist():
                    own = values[numbers == number]
                    held.setdefault(number, []).append(own)
                    size[number] = size.get(number, 0) + len(own)
                    if size[number] >= PIECE:
                        yield piece(number)
        for number in list(held):
            yield piece(number)

    rows = cells.rows(list(_by_position(brackets)))
    return rows.mapInArrow(thin, "bracket int, value double")


def _propose(cells: Cells, brackets: Sequence[Bracket]) -> dict[int, np.ndarray]:
    """Edges around the wanted ranks of each position, from a sketch of each bracket."""
    grid = [i / GRID for i in range(GRID + 1)]
    sketches = {
        row["bracket"]: row["points"]
        for row in _thinned(cells, brackets)
        .groupBy("bracket")
        .agg(F.percentile_approx("value", grid, SKETCH_ACCURACY).alias("points"))
        .collect()
    }
    edges: dict[int, set[float]] = {}
    for index, parent in enumerate(brackets):
        points = sketches[index]
        own = edges.setdefault(parent.pos, set())
        for rank in parent.ranks:
            cell = (rank - parent.before) * GRID // max(1, parent.inside - 1)
            own |= {points[max(0, cell - 1)], points[min(GRID, cell + 2)]}
        own |= {e for e in (parent.low, parent.high) if math.isfinite(e)}
    return {pos: np.array(sorted(own)) for pos, own in edges.items()}


def _slot_counts(cells: Cells, edges: Mapping[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Rows of each position below, on and between its edges: slot 2 i + 1 is edge i itself."""
    read, positions = cells.read, list(edges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {pos: np.zeros(2 * len(e) + 1, np.int64) for pos, e in edges.items()}
        for batch in batches:
            for pos, v in read(positions, batch):
                e = edges[pos]
                slot = np.searchsorted(e, v, side="left") + np.searchsorted(e, v, side="right")
                totals[pos] += np.bincount(slot, minlength=2 * len(e) + 1)
        for pos, total in totals.items():
            slots = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(slots), pos, np.int32)),
                    pa.array(slots.astype(np.int32)),
                    pa.array(total[slots]),
                ],
                names=["pos", "slot", "n"],
            )

    summed = cells.rows(positions).mapInArrow(count, "pos int, slot int, n long").groupBy("pos", "slot").agg(
        F.sum("n").alias("n")
    )
    out = {pos: np.zeros(2 * len(e) + 1, np.int64) for pos, e in edges.items()}
    for row in summed.collect():
        out[row["pos"]][row["slot"]] = row["n"]
    return out


def _confirm(
    cells: Cells,
    edges: Mapping[int, np.ndarray],
    parents: Sequence[Bracket],
    found: dict[tuple[int, int], float],
) -> list[Bracket]:
    """Count the rows between the edges and place the wanted ranks.

    Ranks that fall on an edge are added to ``found``: an edge may be one value with a third of all
    rows. The others get the gap between two edges that they are in.
    """
    counts = _slot_counts(cells, edges)
    wanted: dict[tuple[int, int], list[int]] = {}
    for parent in parents:
        ends = np.cumsum(counts[parent.pos])
        for rank in parent.ranks:
            slot = int(np.searchsorted(ends, rank, side="right"))
            if slot % 2:
                found[parent.pos, rank] = float(edges[parent.pos][slot // 2])
            else:
                wanted.setdefault((parent.pos, slot), []).append(rank)
    out = []
    for (pos, slot), ranks in sorted(wanted.items()):
        e, n = edges[pos], counts[pos]
        low = float(e[slot // 2 - 1]) if slot else -INFINITY
        high = float(e[slot // 2]) if slot // 2 < len(e) else INFINITY
        out.append(Bracket(pos, low, high, int(n[:slot].sum()), int(n[slot]), tuple(ranks)))
    return out


def _read(cells: Cells, brackets: Sequence[Bracket]) -> dict[tuple[int, int], float]:
    """Sort the rows left in each bracket and read the values at the wanted ranks."""
    if not brackets:
        return {}
    rows = _tagged(cells, brackets)
    order = Window.partitionBy("bracket").orderBy("value")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = {
        i: (np.array(sorted(b.ranks)) - b.before, sorted(b.ranks)) for i, b in enumerate(brackets)
    }

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bracket, value, n, end = (
                batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("bracket", "value", "n", "end")
            )
            picked: list[tuple[int, int, float]] = []
            for i in np.unique(bracket).tolist():
                own = np.nonzero(bracket == i)[0]
                at, ranks = places[i]
                first = np.searchsorted(at, (end - n)[own], side="left")
                last = np.searchsorted(at, end[own], side="left")
                for k in np.nonzero(last > first)[0].tolist():
                    v = float(value[own[k]])
                    picked += [(i, ranks[j], v) for j in range(first[k], last[k])]
            columns = list(zip(*picked, strict=True)) or [(), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["bracket", "rank", "value"]
            )

    counted = value_counts(rows, "bracket", "value").withColumn("end", F.sum("n").over(upto))
    picked = counted.select("bracket", "value", "n", "end").mapInArrow(
        pick, "bracket int, rank long, value double"
    )
    return {
        (brackets[row["bracket"]].pos, row["rank"]): row["value"] for row in picked.collect()
    }

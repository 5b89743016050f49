"""Pairwise Pearson correlation and straight-line fits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence, Set
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulens.session import small_table

# Up to this many sums fit one generated aggregate; with many more it is no longer compiled. Wider
# tables multiply blocks of rows as matrices instead, so that they too are read once.
MOST_SUMS = 64

# A spread this small next to the values' distance from the centre is rounding noise.
NOISE = 1e-12

# Below this, the distance eats up digits of the spread, and the pair gets a centre of its own.
NEAR = 1e-6

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
PAIR_SUMS = ("pos_a", "pos_b", *SUMS)
PAIR_SCHEMA = (
    "pos_a int, pos_b int, n bigint, sx double, sy double, sxx double, syy double, sxy double"
)


def correlation_pairs(
    df: DataFrame,
    values: Mapping[int, Column],
    most_sums: int = MOST_SUMS,
) -> DataFrame:
    """(pos_a, pos_b, r, n) for every pair of columns, pos_a before pos_b.

    ``r`` uses the rows where both values are present; it is NULL for fewer than two rows
    or a constant side. One scan finds the means, a second one the sums around them, and
    each task sends one row per pair at most. Where gaps leave a pair only rows far from the means
    of its columns, a third scan sums these pairs around their own.
    """
    positions = sorted(values)
    if len(positions) < 2:
        return small_table(df.sparkSession, [], "pos_a int, pos_b int, r double, n bigint")
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(values[pos]).alias(f"mean{pos}") for pos in positions],
        *[F.count(values[pos]).alias(f"n{pos}") for pos in positions],
    ).first()
    centred = df.select(
        *[(values[pos] - F.lit(facts[f"mean{pos}"] or 0.0)).alias(f"v{pos}") for pos in positions]
    )
    complete = {pos for pos in positions if facts[f"n{pos}"] == facts["rows"]}
    if _number_of_sums(len(positions), len(complete)) <= most_sums:
        sums = _sums_by_expression(centred, positions, complete)
    else:
        sums = _sums_by_block(centred, positions)
    found = {(row["pos_a"], row["pos_b"]): tuple(row) for row in sums.select(*PAIR_SUMS).collect()}
    means = {pos: facts[f"mean{pos}"] or 0.0 for pos in positions}
    far = {
        (a, b): (means[a] + sx / n, means[b] + sy / n)
        for a, b, n, sx, sy, sxx, syy, _ in found.values()
        if not {a, b} <= complete and n > 1 and (_is_far(n, sx, sxx) or _is_far(n, sy, syy))
    }
    if far:
        again = _sums_around(df, values, far).select(*PAIR_SUMS)
        found |= {(row["pos_a"], row["pos_b"]): tuple(row) for row in again.collect()}
    sums = small_table(df.sparkSession, found.values(), PAIR_SCHEMA)
    return sums.select("pos_a", "pos_b", _pearson().alias("r"), "n")


def _is_far(n: int, s: float, ss: float) -> bool:
    """Whether the rows of a pair lie far from the centre they are summed around."""
    return n * ss - s * s <= NEAR * n * ss and s != 0


def _number_of_sums(columns: int, complete: int) -> int:
    pairs = columns * (columns - 1) // 2
    shared = complete * (complete - 1) // 2
    return 3 * complete + pairs + 5 * (pairs - shared)


def _pearson() -> Column:
    n, sx, sy, sxx, syy, sxy = (F.col(name) for name in SUMS)
    x_spread, y_spread = n * sxx - sx * sx, n * syy - sy * sy
    varies = (n > 1) & (x_spread > NOISE * n * sxx) & (y_spread > NOISE * n * syy)
    # NULL instead of a spread of zero keeps the division safe
    scale = F.when(varies, F.sqrt(x_spread) * F.sqrt(y_spread))
    r = (n * sxy - sx * sy) / scale
    # rounding may leave the range by a hair
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _sums_by_expression(
    centred: DataFrame, positions: Sequence[int], complete: Set[int]
) -> DataFrame:
    """Sums of products in one aggregate.

    Two columns without gaps share their own sums and add only their product; any other
    pair sums the rows where neither side is missing.
    """

    def v(pos: int) -> Column:
        return F.col(f"v{pos}")

    sums = [
        term.alias(f"{name}_{pos}")
        for pos in complete
        for name, term in (
            ("n", F.count(v(pos))), ("s", F.sum(v(pos))), ("q", F.sum(v(pos) * v(pos))),
        )
    ]
    rows = []
    for a, b in combinations(positions, 2):
        sums.append(F.sum(v(a) * v(b)).alias(f"sxy_{a}_{b}"))
        names = {"sxy": f"sxy_{a}_{b}"}
        if a in complete and b in complete:
            names |= {"n": f"n_{a}", "sx": f"s_{a}", "sy": f"s_{b}", "sxx": f"q_{a}", "syy": f"q_{b}"}
        else:
            x, y = F.when(v(b).isNotNull(), v(a)), F.when(v(a).isNotNull(), v(b))
            own = {"n": F.count(v(a) * v(b)), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x),
                   "syy": F.sum(y * y)}
            sums += [term.alias(f"{name}_{a}_{b}") for name, term in own.items()]
            names |= {name: f"{name}_{a}_{b}" for name in own}
        shown = [F.col(names[name]).alias(name) for name in SUMS]
        rows.append(F.struct(F.lit(a).alias("pos_a"), F.lit(b).alias("pos_b"), *shown))
    return centred.agg(*sums).select(F.inline(F.array(*rows)))


def _sums_by_block(centred: DataFrame, positions: Sequence[int]) -> DataFrame:
    """The same sums for many columns, as matrix products over batches of rows."""
    places = np.array(positions)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(places))]
            block = np.column_stack(columns).astype(float)
            present = (~np.isnan(block)).astype(float)
            block = np.nan_to_num(block)
            products = np.stack(
                [present.T @ present, block.T @ present, (block**2).T @ present, block.T @ block]
            )
            total = products if total is None else total + products
        if total is not None:
            i, j = np.triu_indices(len(places), 1)
            n, s, ss, sxy = total
            arrays = [places[i], places[j], n[i, j].astype("int64"), s[i, j], s[j, i], ss[i, j],
                      ss[j, i], sxy[i, j]]
            names = ["pos_a", "pos_b", "n", "sx", "sy", "sxx", "syy", "sxy"]
            arrays[:2] = [place.astype("int32") for place in arrays[:2]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    partial = centred.mapInArrow(multiply, PAIR_SCHEMA)
    return partial.groupBy("pos_a", "pos_b").agg(*[F.sum(name).alias(name) for name in SUMS])


def _sums_around(
    df: DataFrame,
    values: Mapping[int, Column],
    centres: Mapping[tuple[int, int], tuple[float, float]],
) -> DataFrame:
    """The same sums for some pairs, each around centres of its own."""
    positions = sorted({pos for pair in centres for pos in pair})
    wide = df.select(*[values[pos].cast("double").alias(str(pos)) for pos in positions])
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {pair: np.zeros(6) for pair in centres}
        for batch in batches:
            cells = {
                pos: batch.column(i).to_numpy(zero_copy_only=False)
                for i, pos in enumerate(positions)
            }
            for (a, b), (x0, y0) in centres.items():
                x, y = cells[a] - x0, cells[b] - y0
                both = ~(np.isnan(x) | np.isnan(y))
                x, y = x[both], y[both]
                totals[a, b] += [len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y]
        rows = [(*pair, *total) for pair, total in totals.items()]
        arrays = [pa.array(c).cast(kind) for c, kind in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=list(PAIR_SUMS))

    partial = wide.mapInArrow(add, PAIR_SCHEMA)
    return partial.groupBy("pos_a", "pos_b").agg(*[F.sum(name).alias(name) for name in SUMS])


def correlation_matrix(pairs: DataFrame, constant: DataFrame, digits: int = 3) -> DataFrame:
    """Both halves and the diagonal: (pos_a, pos_b, r).

    ``constant`` holds (pos, r) with 1 for a column that varies and NULL for one that
    does not. Both frames are as small as the square of the number of columns.
    """
    upper = pairs.select("pos_a", "pos_b", "r")
    lower = pairs.select(F.col("pos_b").alias("pos_a"), F.col("pos_a").alias("pos_b"), "r")
    diagonal = constant.select(F.col("pos").alias("pos_a"), F.col("pos").alias("pos_b"), "r")
    return (
        upper.unionByName(lower)
        .unionByName(diagonal)
        .withColumn("r", F.round("r", digits) + F.lit(0.0))
    )


def line_fit(points: DataFrame) -> DataFrame:
    """Least-squares line of (x, y): slope, intercept and both ends; needs three points."""
    slope, intercept = F.regr_slope("y", "x"), F.regr_intercept("y", "x")
    fit = points.agg(
        F.count(F.lit(1)).alias("n"),
        slope.alias("slope"),
        intercept.alias("intercept"),
        F.min("x").alias("x_start"),
        F.max("x").alias("x_end"),
    ).where((F.col("n") >= 3) & F.col("slope").isNotNull())

    def at(x: str) -> Column:
        return F.round(F.col("slope") * F.col(x) + F.col("intercept"), 4)

    return fit.select(
        F.round("slope", 6).alias("slope"),
        F.round("intercept", 6).alias("intercept"),
        F.round("x_start", 4).alias("x_start"),
        F.round("x_end", 4).alias("x_end"),
        at("x_start").alias("y_start"),
        at("x_end").alias("y_end"),
    )

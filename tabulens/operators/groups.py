"""Summaries per category, and category tables.

Inputs hold (grp, value) for a category with a number, (grp, other) for two categories.
Group counts are combined on the map side. Only the top groups, a fixed handful, are ever
broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabulens.functions.numbers import rounded
from tabulens.functions.text import named
from tabulens.operators.density import density
from tabulens.operators.frequency import BROADCAST_VALUES, text_key, top_k, value_counts
from tabulens.operators.quantiles import DIRECT_ROWS, exact_quantiles
from tabulens.session import pin, small_table

QUARTILES = (0.25, 0.5, 0.75)


# a value with more than this share of the rows is joined by a broadcast
HOT_SHARE = 0.001


def drop_small_groups(
    df: DataFrame, column: str, min_rows: int = 5, min_groups: int = 2
) -> DataFrame:
    """Rows whose category occurs at least ``min_rows`` times; rows without one go.

    Nothing is left if fewer than ``min_groups`` categories qualify. Categories are counted
    once, under keys of bounded length.
    """
    key = "_group"
    while key in df.columns:
        key += "_"
    value = named(column)
    if isinstance(df.select(value).schema[0].dataType, T.StringType):
        longest = df.agg(F.max(F.length(value))).first()[0] or 0
        value = text_key(value, longest)
    keyed = df.withColumn(key, value)
    counts = value_counts(keyed.where(F.col(key).isNotNull()).select(key), key)
    kept = pin(counts.where(F.col("n") >= min_rows))
    found, rows = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if found < min_groups:
        return df.limit(0)
    return members(keyed, kept, key, found, rows).select(*[named(name) for name in df.columns])


def members(
    df: DataFrame, kept: DataFrame, key: str, found: int, rows: int, most: int = BROADCAST_VALUES
) -> DataFrame:
    """Rows of ``df`` whose key is in ``kept`` (key, n), which has ``found`` keys of ``rows`` rows.

    Few keys are broadcast. Of many, those with more than a thousandth of the rows are, fewer than
    a thousand; the rows of the others are joined by a shuffle, in which no key is hot any more.
    """
    if found <= most:
        return df.join(F.broadcast(kept.select(key)), key, "left_semi")
    is_hot = F.col("n") > rows * HOT_SHARE
    hot = F.broadcast(kept.where(is_hot).select(key))
    tail = kept.where(~is_hot).select(key)
    return df.join(hot, key, "left_semi").unionByName(
        df.join(hot, key, "left_anti").join(tail.hint("merge"), key, "left_semi")
    )


def top_groups(values: DataFrame, k: int, min_rows: int = 1, column: str = "grp") -> DataFrame:
    """(grp, n) of the ``k`` largest groups."""
    counts = value_counts(values.where(F.col(column).isNotNull()), column)
    return top_k(counts.where(F.col("n") >= min_rows), k, value=column)


def only(values: DataFrame, groups: DataFrame, column: str = "grp") -> DataFrame:
    """Rows of the given top groups (at most 30)."""
    return values.join(F.broadcast(groups.select(column)), column, "left_semi")


def enough_groups(top: DataFrame, min_groups: int) -> DataFrame:
    """``top`` (at most 20 rows), or nothing if it has fewer than ``min_groups`` rows."""
    if min_groups <= 1:
        return top
    count = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return top.withColumn("_groups", count).where(F.col("_groups") >= min_groups).drop("_groups")


def group_means(
    values: DataFrame, k: int = 15, min_rows: int = 1, min_groups: int = 1
) -> DataFrame:
    """(grp, mean, std, n) of the ``k`` groups with the highest means."""
    top = (
        values.groupBy("grp")
        .agg(
            F.avg("value").alias("mean"),
            F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
            F.count("value").alias("n"),
        )
        .where(F.col("n") >= min_rows)
        .orderBy(F.desc("mean"), "grp")
        .limit(k)
    )
    return enough_groups(top, min_groups).select(
        "grp", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "n"
    )


def lowest_means(
    values: DataFrame, k: int = 15, min_rows: int = 1, min_groups: int = 1
) -> DataFrame:
    """(grp, mean) of the ``k`` groups with the lowest means, ascending."""
    top = (
        values.groupBy("grp")
        .agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
        .where(F.col("n") >= min_rows)
        .orderBy("mean", "grp")
        .limit(k)
    )
    return enough_groups(top, min_groups).select("grp", rounded(F.col("mean")).alias("mean"))


def box_summary(
    values: DataFrame,
    groups: Sequence[tuple[str, int]],
    order_by: Sequence[str] = (),
    max_outliers: int = 30,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """(grp, min, q1, median, q3, max, outliers) per group, quartiles exact.

    ``groups`` lists (grp, rows), a dozen at most. ``outliers`` are the first values beyond
    1.5 IQR in row order, at most 30; every task picks its own first 30 before the shuffle.
    Without ``order_by`` the smallest values come first.
    """
    positions = {name: i for i, (name, _) in enumerate(groups)}
    table = small_table(values.sparkSession, positions.items(), "grp string, pos int")
    tagged = values.join(F.broadcast(table), "grp")
    sizes = {positions[name]: n for name, n in groups}
    long = tagged.select("pos", "value")
    quartiles = [
        (row["pos"], *row["q"])
        for row in exact_quantiles(long, QUARTILES, sizes, direct_rows).collect()
    ]
    found = small_table(
        values.sparkSession, quartiles, "pos int, q1 double, median double, q3 double"
    )
    ends = tagged.groupBy("pos", "grp").agg(
        F.min("value").alias("min"), F.max("value").alias("max")
    )
    boxes = ends.join(F.broadcast(found), "pos")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = found.select("pos", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))
    keys = list(order_by) or ["value"]
    order = Window.partitionBy("pos").orderBy(*keys)
    outside = (
        tagged.join(F.broadcast(fences), "pos")
        .where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
        .withColumn("_seq", F.row_number().over(order))
        .where(F.col("_seq") <= max_outliers)
    )
    listed = outside.groupBy("pos").agg(
        F.sort_array(F.collect_list(F.struct("_seq", "value"))).alias("listed")
    )
    none = F.array().cast("array<double>")
    return boxes.join(F.broadcast(listed), "pos", "left").select(
        "grp",
        "min",
        "q1",
        "median",
        "q3",
        "max",
        F.coalesce(F.col("listed.value"), none).alias("outliers"),
    )


def group_sizes(groups: DataFrame) -> list[tuple[str, int]]:
    """Collect (grp, n) of the top groups, largest first."""
    rows = [(row["grp"], row["n"]) for row in groups.collect()]
    return sorted(rows, key=lambda g: (-g[1], g[0]))


def density_groups(
    values: DataFrame, names: Sequence[str]
) -> list[tuple[str, float, float, float, int]]:
    """(grp, min, max, std, n) of the named groups."""
    summary = values.where(F.col("grp").isin(*names)).groupBy("grp").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.stddev_samp("value").alias("std"),
        F.count("value").alias("n"),
    )
    return [(r["grp"], r["low"], r["high"], r["std"], r["n"]) for r in summary.collect()]


def grouped_density(values: DataFrame, names: Sequence[str]) -> DataFrame:
    return density(values, density_groups(values, names))


def crosstab(pairs: DataFrame, top_x: int, top_y: int) -> DataFrame:
    """(grp, other, n) over the most frequent values of each side, zeros included.

    The table is counted once; both rankings and the cells come from the written counts. Only
    values that meet a top value of the other side appear.
    """
    counts = pin(value_counts(pairs, "grp", "other"))
    cells = _top_cells(counts, _margin(counts, "grp", top_x), _margin(counts, "other", top_y))
    return _filled(cells, cells.select("grp").distinct(), cells.select("other").distinct())


def _margin(counts: DataFrame, side: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of one side of the pair counts."""
    return top_k(value_counts(counts, side, weight="n"), k, side)


def _top_cells(counts: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    return only(only(counts, xs, "grp"), ys, "other")


def _filled(cells: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """A cell for each pair of labels, 0 where no row has both (at most 15 by 15 labels)."""
    others = ys.agg(F.collect_list("other")).scalar()
    grid = xs.select("grp", F.explode(others).alias("other"))
    return grid.join(F.broadcast(cells), ["grp", "other"], "left").select(
        "grp", "other", F.coalesce("n", F.lit(0)).alias("n")
    )


def category_heatmap(pairs: DataFrame, k: int = 15) -> DataFrame:
    """(grp, other, x_rank, y_rank, n): the top ``k`` of each side in order of frequency."""
    counts = pin(value_counts(pairs, "grp", "other"))
    xs, ys = _margin(counts, "grp", k), _margin(counts, "other", k)
    return (
        _filled(_top_cells(counts, xs, ys), xs, ys)
        .join(F.broadcast(_positions(xs, "grp", "x_rank")), "grp")
        .join(F.broadcast(_positions(ys, "other", "y_rank")), "other")
        .select("grp", "other", "x_rank", "y_rank", "n")
    )


def _positions(labels: DataFrame, name: str, rank: str) -> DataFrame:
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), name)  # at most 15 rows
    return labels.select(name, F.row_number().over(order).alias(rank))


def mean_heatmap(
    values: DataFrame, k: int = 20, min_rows: int = 1, min_groups: int = 1
) -> DataFrame:
    """(grp, rank, mean) for the ``k`` largest groups in order of size."""
    summary = (
        values.groupBy("grp")
        .agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_rows)
    )
    top = enough_groups(top_k(summary, k, "grp"), min_groups)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "grp")  # at most 20 rows
    return top.select(
        "grp", F.row_number().over(order).alias("rank"), rounded(F.col("mean")).alias("mean")
    )

"""Chart data as tidy DataFrames: one row per bin, group, cell or point.

A chart knows how to build its frame and does so when asked, so listing the charts of a
table runs nothing. Frames only hold the reduced data; the table itself stays where it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from tabulens.functions.numbers import null_non_finite
from tabulens.functions.text import named
from tabulens.operators.bins import bin_count, discrete_histogram, histogram
from tabulens.operators.correlation import correlation_matrix, correlation_pairs, line_fit
from tabulens.operators.frequency import ranked, top_k, value_counts
from tabulens.operators.groups import (
    box_summary,
    category_heatmap,
    crosstab,
    group_means,
    group_sizes,
    grouped_density,
    lowest_means,
    mean_heatmap,
    top_groups,
)
from tabulens.operators.ordinal import every_nth, key_names, order_keys, with_ordinal
from tabulens.operators.quantiles import values_at_ranks
from tabulens.operators.sampling import SAMPLE_ROWS, sample_rows, scatter_outliers, smallest_share
from tabulens.plans.choose import ALTERNATIVES, choose_charts, choose_pair_charts
from tabulens.plans.profile import Metrics, profile_frame
from tabulens.plans.types import ColumnType
from tabulens.session import pin, small_table

# How much of a column a chart shows.
LINE_POINTS, MASK_ROWS = 200, 100
BAR_TOP, PIE_TOP, TREEMAP_TOP, BOX_TOP, VIOLIN_TOP = 20, 8, 30, 12, 6
STACK_X, STACK_Y = 10, 6
DISCRETE_VALUES = 30
GROUP_ROWS, GROUPS_LEAST = 5, 2
BOX_ROWS, VIOLIN_ROWS = 4, 10
PAIR_ROWS, DATE_PAIR_ROWS, SINGLE_ROWS = 5, 2, 3

NUMERIC_CHARTS = ("histogram", "boxplot", "violin", "line")
CATEGORY_CHARTS = ("bar", "lollipop", "pie", "donut", "treemap")


@dataclass
class Chart:
    """One chart: what it shows and, on demand, its data."""

    key: str
    chosen: str
    built: str
    title: str
    col_x: str | None
    col_y: str | None
    build: Callable[[], DataFrame]
    recommended: bool = True
    alternatives: tuple[str, ...] = ()
    correlation: float | None = None
    distribution: str = ""
    parts: Mapping[str, Callable[[], DataFrame]] = field(default_factory=dict)

    @property
    def priority(self) -> str:
        return "high" if self.recommended else "low"

    @cached_property
    def frame(self) -> DataFrame:
        return self.build()

    def part(self, name: str) -> DataFrame:
        """Further data of the chart, such as the trend line of a scatter plot."""
        return self.parts[name]()


# one column ---------------------------------------------------------------------------


def numbers(df: DataFrame, column: ColumnType, order_by: Sequence[str] = ()) -> DataFrame:
    rows = df.select(column.number.alias("value"), *order_keys(order_by))
    return rows.where(F.col("value").isNotNull())


def _spread(df: DataFrame, column: ColumnType, metrics: Metrics) -> Metrics:
    """Metrics of a numeric column; a single value has none in the profile."""
    if metrics.get("n_valid"):
        return metrics
    only = numbers(df, column).agg(F.max("value")).first()[0]
    whole = only is not None and float(only).is_integer()
    return dict(
        n_valid=int(only is not None), min=only, max=only, q1=only, q3=only, n_unique_vals=1,
        all_integers=whole,
    )


def histogram_data(df: DataFrame, column: ColumnType, metrics: Metrics) -> DataFrame:
    """(bin, lo, hi, label, n): one bar per value for few integers, else even bins."""
    m = _spread(df, column, metrics)
    values = numbers(df, column)
    if m["all_integers"] and m["n_unique_vals"] <= DISCRETE_VALUES:
        bars = discrete_histogram(values)
        bin_no = F.row_number().over(_small_order("value")) - 1
        edge = F.col("value")
        return bars.select(
            bin_no.alias("bin"), edge.alias("lo"), edge.alias("hi"), "label", "n"
        )
    k = bin_count(m["n_valid"], m["min"], m["max"], m["q3"] - m["q1"])
    return histogram(values, m["min"], m["max"], k)


def _small_order(*keys: str | Column) -> WindowSpec:
    """Order over a frame of a few rows, such as the bars of one chart."""
    return Window.partitionBy(F.lit(1)).orderBy(*keys)


def distribution_tag(metrics: Metrics | None) -> str:
    if not metrics:
        return ""
    skew = round(metrics.get("skewness") or 0.0, 4)
    if abs(skew) < 0.5:
        return "normal-like"
    if abs(skew) > 1.0:
        return "right-skewed" if skew > 0 else "left-skewed"
    return "mildly skewed"


def box_data(
    df: DataFrame, column: ColumnType, metrics: Metrics, order_by: Sequence[str] = ()
) -> DataFrame:
    m = _spread(df, column, metrics)
    values = numbers(df, column, order_by).withColumn("grp", F.lit(column.name))
    return box_summary(values, [(column.name, m["n_valid"])], key_names(order_by))


def violin_data(df: DataFrame, column: ColumnType) -> DataFrame:
    """(grp, point, x, density); empty for a constant column."""
    values = numbers(df, column).withColumn("grp", F.lit(column.name))
    return grouped_density(values, [column.name])


def index_line(df: DataFrame, column: ColumnType, order_by: Sequence[str] = ()) -> DataFrame:
    """(row, value): about 200 evenly spaced non-null values with their row numbers."""
    values = df.select(*order_keys(order_by), column.number.alias("value"))
    rows = with_ordinal(values, key_names(order_by), "row")
    present = rows.where(F.col("value").isNotNull()).select("row", "value")
    if column.present < column.total or not column.is_measured:
        present = with_ordinal(present, ["row"])
        return every_nth(present, present.count(), LINE_POINTS).select("row", "value")
    return every_nth(present, column.total, LINE_POINTS, "row")


def timeline(df: DataFrame, column: ColumnType) -> DataFrame:
    """(point, ts): about 200 evenly spaced dates in order, numbered from 0.

    The dates at the wanted ranks are looked up in the value counts, so a date shared by
    many rows is one value, and a long column is narrowed instead of sorted.
    """
    # of the time as written, in no zone; microseconds stay exact as a double
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (column.timestamp.cast("timestamp_ntz") - epoch).cast("interval second")
    micros = (seconds.cast("decimal(18,6)") * 1_000_000).cast("double")
    long = df.select(F.lit(0).alias("pos"), micros.alias("value")).where(F.col("value").isNotNull())
    n = long.count()
    ranks = range(0, n, max(1, n // LINE_POINTS))
    found = values_at_ranks(long, {0: ranks}, {0: n}) if n else {}
    rows = [(point, int(found[0, rank])) for point, rank in enumerate(ranks)]
    table = small_table(df.sparkSession, rows, "point bigint, micros bigint")
    passed = F.make_dt_interval(secs=(F.col("micros") / F.lit(1_000_000)).cast("decimal(18,6)"))
    return table.select("point", (epoch + passed).alias("ts"))


def category_counts(df: DataFrame, column: ColumnType) -> DataFrame:
    labels = df.select(column.text.alias("label")).where(F.col("label").isNotNull())
    return value_counts(labels, "label")


def bar_data(df: DataFrame, column: ColumnType, k: int = BAR_TOP) -> DataFrame:
    """(label, n) of the most frequent values, the largest first."""
    return top_k(category_counts(df, column), k, "label")


def lollipop_data(df: DataFrame, column: ColumnType) -> DataFrame:
    """As ``bar_data``, the smallest first."""
    return bar_data(df, column).orderBy("n", F.desc("label"))


def pie_data(df: DataFrame, column: ColumnType) -> DataFrame:
    """(label, n): the eight most frequent values and, if any rows are left, ``Other``."""
    # a categorical column has at most 100 values
    slots = ranked(category_counts(df, column).withColumn("all", F.lit(1)), ["all"], "label")
    slot = F.least("rank", F.lit(PIE_TOP + 1))
    label = F.when(slot > PIE_TOP, "Other").otherwise(F.col("label"))
    return (
        slots.groupBy(slot.alias("slot"), label.alias("label"))
        .agg(F.sum("n").alias("n"))
        .orderBy("slot")
        .select("label", "n")
    )


# two columns --------------------------------------------------------------------------


def points(
    df: DataFrame, x: ColumnType, y: ColumnType, order_by: Sequence[str] = ()
) -> DataFrame:
    pairs = df.select(x.number.alias("x"), y.number.alias("y"), *order_keys(order_by))
    return pairs.dropna(subset=["x", "y"])


def scatter_data(
    df: DataFrame, x: ColumnType, y: ColumnType, order_by: Sequence[str] = ()
) -> DataFrame:
    """(x, y) of at most 600 rows, drawn by a keyed digest of the order columns, and those.

    Without order columns rows are drawn by their place in the reading, so that equal points are
    drawn as often as they occur.
    """
    if order_by:
        return sample_rows(points(df, x, y, order_by), key_names(order_by), SAMPLE_ROWS)
    drawn = points(_placed(df), x, y, [PLACE])
    return sample_rows(drawn, key_names([PLACE]), SAMPLE_ROWS).select("x", "y")


PLACE = "_place_in_reading"


def _placed(df: DataFrame) -> DataFrame:
    if PLACE in df.columns:
        return df
    return df.withColumn(PLACE, F.monotonically_increasing_id())


# rows that the shared sample should hold of each pair, and the least share of complete rows that
# a pair needs to take part: the sample has 100 times as many rows at most
SHARED_ROWS, SHARED_COMPLETE = 3200, 0.01


class SharedSample:
    """The rows that the samples of all scatter charts come from, drawn in one scan.

    A row has one digest whatever the pair. The rows with the lowest digests are therefore written
    once, enough of them for each pair, and a chart picks its 600 smallest among them: the same
    rows as from the whole table. Pairs for which they do not suffice, as few rows have both
    values or many share an order key, are drawn from the table.
    """

    def __init__(
        self,
        df: DataFrame,
        pairs: Mapping[tuple[str, str], tuple[ColumnType, ColumnType, int]],
        order_by: Sequence[str] = (),
    ) -> None:
        """``pairs`` maps the names of two columns to them and their number of complete rows."""
        self.df, self.order_by = df, tuple(order_by)
        enough = {k: p for k, p in pairs.items() if p[2] >= SHARED_COMPLETE * p[0].total}
        # alone, a pair is drawn just as well from the table
        self.pairs = enough if len(enough) > 1 else {}

    @cached_property
    def rows(self) -> DataFrame:
        names = [c.name for x, y, _ in self.pairs.values() for c in (x, y)]
        df = self.df if self.order_by else _placed(self.df)
        key = list(self.order_by) or [PLACE]
        share = SHARED_ROWS / max(1, min(n for _, _, n in self.pairs.values()))
        drawn = smallest_share(df, [named(k) for k in key], share)
        return pin(drawn.select(*[named(n) for n in dict.fromkeys([*names, *key])]))

    @cached_property
    def held(self) -> set[tuple[str, str]]:
        """The pairs whose whole sample is among the rows."""
        sampled = [(x, y) for x, y, _ in self.pairs.values()]
        found = zip(self.pairs.items(), _complete_rows(self.rows, sampled, self.rows.count()))
        return {key for (key, (_, _, n)), got in found if got >= min(n, SAMPLE_ROWS)}

    def source(self, x: ColumnType, y: ColumnType) -> DataFrame:
        key = (x.name, y.name)
        return self.rows if key in self.pairs and key in self.held else self.df


def scatter_outlier_data(
    df: DataFrame, x: ColumnType, y: ColumnType, order_by: Sequence[str] = ()
) -> DataFrame:
    sample = pin(scatter_data(df, x, y, order_by))  # drawn once for quartiles and points
    return scatter_outliers(sample, key_names(order_by) or ["x", "y"])


def xy_line(df: DataFrame, x: ColumnType, y: ColumnType) -> DataFrame:
    return points(df, x, y).orderBy("x", "y")


def dated_values(
    df: DataFrame, date: ColumnType, other: ColumnType, order_by: Sequence[str] = ()
) -> DataFrame:
    """(point, ts, value): about 200 evenly spaced rows in date order.

    A category next to a date gives its text as the value.
    """
    value = other.text if other.kind == "categorical" else other.number
    rows = df.select(date.timestamp.alias("ts"), value.alias("value"), *order_keys(order_by))
    rows = rows.dropna(subset=["ts", "value"])
    n = rows.count()
    step = max(1, n // LINE_POINTS)
    numbered = with_ordinal(rows, ["ts", *(key_names(order_by) or ["value"])])
    picked = every_nth(numbered, n, LINE_POINTS)
    return picked.select((F.col("_rid") / step).cast("long").alias("point"), "ts", "value")


def grouped(
    df: DataFrame, category: ColumnType, number: ColumnType, order_by: Sequence[str] = ()
) -> DataFrame:
    keys = order_keys(order_by)
    rows = df.select(category.text.alias("grp"), number.number.alias("value"), *keys)
    return rows.dropna(subset=["grp", "value"])


def _least_groups(min_rows: int) -> int:
    """Where small groups are dropped, one remaining group is not enough."""
    return GROUPS_LEAST if min_rows > 1 else 1


def grouped_bar_data(values: DataFrame, min_rows: int = 1) -> DataFrame:
    return group_means(values, min_rows=min_rows, min_groups=_least_groups(min_rows))


def grouped_lollipop_data(values: DataFrame, min_rows: int = 1) -> DataFrame:
    return lowest_means(values, min_rows=min_rows, min_groups=_least_groups(min_rows))


def grouped_heatmap_data(values: DataFrame, min_rows: int = 1) -> DataFrame:
    return mean_heatmap(values, min_rows=min_rows, min_groups=_least_groups(min_rows))


def _largest(values: DataFrame, k: int, min_rows: int) -> list[tuple[str, int]]:
    sizes = group_sizes(top_groups(values, k, min_rows))
    return sizes if len(sizes) >= _least_groups(min_rows) else []


def grouped_box_data(
    values: DataFrame, order_by: Sequence[str] = (), min_rows: int = 1
) -> DataFrame:
    """Box summaries of the 12 largest groups; with under 4 rows only a flag."""
    sizes = _largest(values, BOX_TOP, min_rows)
    large = [size for size in sizes if size[1] >= BOX_ROWS]
    boxes = box_summary(values, large, key_names(order_by))
    return _with_insufficient(boxes, sizes, BOX_ROWS)


def grouped_violin_data(values: DataFrame, min_rows: int = 1) -> DataFrame:
    """Density curves of the 6 largest groups; with under 10 rows only a flag."""
    sizes = _largest(values, VIOLIN_TOP, min_rows)
    curves = grouped_density(values, [name for name, n in sizes if n >= VIOLIN_ROWS])
    return _with_insufficient(curves, sizes, VIOLIN_ROWS)


def _with_insufficient(
    frame: DataFrame, sizes: Sequence[tuple[str, int]], least: int
) -> DataFrame:
    flagged = frame.withColumn("insufficient_data", F.lit(False))
    small = [(name, True) for name, n in sizes if n < least]
    if not small:
        return flagged
    rest = small_table(frame.sparkSession, small, "grp string, insufficient_data boolean")
    return flagged.unionByName(rest, allowMissingColumns=True)


def label_pairs(df: DataFrame, x: ColumnType, y: ColumnType) -> DataFrame:
    return df.select(x.text.alias("grp"), y.text.alias("other")).dropna()


# whole table --------------------------------------------------------------------------


def correlations(df: DataFrame, types: Sequence[ColumnType]) -> DataFrame:
    """(pos_a, pos_b, r, n) over all numeric columns."""
    return correlation_pairs(df, {c.pos: c.number for c in types if c.kind == "numeric"})


def correlation_data(
    df: DataFrame, types: Sequence[ColumnType], metrics: Sequence[Metrics], pairs: DataFrame
) -> DataFrame:
    """(col_a, col_b, r): the full matrix, rounded to three places."""
    numeric = [c for c in types if c.kind == "numeric"]
    varies = {m["position"]: bool(m.get("std")) for m in metrics}
    booleans = [c for c in numeric if not c.is_measured]
    if booleans:
        ends = df.agg(
            *[(F.min(c.number) < F.max(c.number)).alias(str(c.pos)) for c in booleans]
        ).first()
        varies.update({c.pos: bool(ends[str(c.pos)]) for c in booleans})
    own = [(c.pos, 1.0 if varies[c.pos] else None) for c in numeric]
    diagonal = small_table(df.sparkSession, own, "pos int, r double")
    names = small_table(
        df.sparkSession, [(c.pos, c.name) for c in numeric], "pos int, column string"
    )
    return (
        correlation_matrix(pairs, diagonal)
        .join(F.broadcast(names.toDF("pos_a", "col_a")), "pos_a")
        .join(F.broadcast(names.toDF("pos_b", "col_b")), "pos_b")
        .select("col_a", "col_b", "r")
    )


def missing_mask(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """0/1 per cell for about 100 evenly spaced rows, with the row number ``_rid``.

    Only the order columns and a text of one character per column are sorted, not the table.
    """

    def flag(f: T.StructField) -> Column:
        value = named(f.name)
        present = null_non_finite(value) if f.dataType.typeName() in ("float", "double") else value
        return F.when(present.isNull(), "1").otherwise("0")

    fields = df.schema.fields
    mask = F.concat(*[flag(f) for f in fields]).alias("_mask")
    rows = with_ordinal(df.select(*order_keys(order_by), mask), key_names(order_by))
    picked = every_nth(rows, df.count(), MASK_ROWS)
    cells = [
        F.substring("_mask", i + 1, 1).cast("int").alias(f.name) for i, f in enumerate(fields)
    ]
    return picked.select("_rid", *cells)


# choosing and building ----------------------------------------------------------------


def report_charts(
    df: DataFrame,
    types: Sequence[ColumnType],
    metrics: Sequence[Metrics],
    pairs: DataFrame,
    order_by: Sequence[str] = (),
) -> dict[str, Chart]:
    """All charts of a table by key: per column, per promising pair, and overall.

    ``pairs`` are the correlations. Only the choice (one row per column and pair) is
    collected.
    """
    prof = profile_frame(df.sparkSession, metrics)
    by_name = {c.name: c for c in types}
    facts = {m["column"]: m for m in metrics}
    charts: dict[str, Chart] = {}
    for row in choose_charts(prof).orderBy("position").collect():
        column = by_name[row["column"]]
        for chart in _column_charts(df, column, facts[column.name], row, order_by):
            charts[chart.key] = chart
    chosen = choose_pair_charts(prof, pairs).where(F.col("keep") & F.col("built").isNotNull())
    rows = chosen.orderBy("x_position", "y_position").collect()
    complete = _complete_rows(df, [(by_name[r["col_x"]], by_name[r["col_y"]]) for r in rows])
    scatters = {
        (row["col_x"], row["col_y"]): (by_name[row["col_x"]], by_name[row["col_y"]], n)
        for row, n in zip(rows, complete)
        if row["roles"] == "numbers" and row["built"] != "line" and n >= PAIR_ROWS
    }
    sample = SharedSample(df, scatters, order_by)
    for row, n in zip(rows, complete):
        x, y = by_name[row["col_x"]], by_name[row["col_y"]]
        least = DATE_PAIR_ROWS if "date" in (x.kind, y.kind) else PAIR_ROWS
        if n >= least:
            chart = _pair_chart(df, x, y, row, order_by, sample)
            charts[chart.key] = chart
    numeric = [c for c in types if c.kind == "numeric"]
    if len(numeric) > 1:
        charts["correlation_matrix"] = Chart(
            "correlation_matrix", "correlation_matrix", "correlation_matrix",
            "Correlation Matrix (Pearson)", None, None,
            lambda: correlation_data(df, types, metrics, pairs),
        )
    charts["missing_heatmap"] = Chart(
        "missing_heatmap", "missing_heatmap", "missing_heatmap", "Missing Values Overview",
        None, None, lambda: missing_mask(df, order_by),
        parts={"rates": lambda: prof.select("column", "missing_rate")},
    )
    return charts


def _complete_rows(
    df: DataFrame, pairs: Sequence[tuple[ColumnType, ColumnType]], total: int | None = None
) -> list[int]:
    """Rows with both values, per pair, as the charts see them: NaN and unread text are gaps.

    ``total`` are the rows of ``df`` where it is only a part of the table.

    Only columns with gaps are looked at together: each task multiplies its 0/1 matrix of present
    values with itself, and the rows of the products are added up.
    """
    columns = list({c.name: c for pair in pairs for c in pair}.values())
    gaps = [c for c in columns if c.present < c.total or _family_has_nan(c)]
    counts: dict[tuple[str, str], int] = {}
    if gaps:
        place = {c.name: i for i, c in enumerate(gaps)}
        present = F.array(*(_shown_value(c).isNotNull() for c in gaps))
        size = len(gaps)
        products = (
            df.select(present.alias("present"))
            .mapInArrow(lambda batches: _present_products(batches, size), "i int, n array<long>")
            .groupBy("i")
            .agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(size)))
            .collect()
        )
        both = {row["i"]: row for row in products}
        alone = {c.name: both[place[c.name]][f"n{place[c.name]}"] if both else 0 for c in gaps}
        for x, y in pairs:
            if x.name in place and y.name in place:
                row = both.get(place[x.name])
                counts[x.name, y.name] = row[f"n{place[y.name]}"] if row else 0
            else:
                rows = x.total if total is None else total
                counts[x.name, y.name] = alone.get(x.name, alone.get(y.name, rows))
    return [
        counts.get((x.name, y.name), x.total if total is None else total) for x, y in pairs
    ]


def _family_has_nan(column: ColumnType) -> bool:
    return isinstance(column.dtype, (T.FloatType, T.DoubleType)) or (
        isinstance(column.dtype, T.StringType) and column.kind in ("numeric", "date")
    )


def _shown_value(column: ColumnType) -> Column:
    """The value as charts use it."""
    if column.kind == "numeric":
        return column.number
    return column.timestamp if column.kind == "date" else column.text


def _present_products(
    batches: Iterator[pa.RecordBatch], size: int
) -> Iterator[pa.RecordBatch]:
    total = np.zeros((size, size), np.int64)
    for batch in batches:
        flat = batch.column("present").flatten().to_numpy(zero_copy_only=False)
        # counts of a batch are exact in single precision
        there = flat.astype(np.float32).reshape(-1, size)
        total += (there.T @ there).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.int64()))],
        names=["i", "n"],
    )


def _column_charts(
    df: DataFrame, column: ColumnType, metrics: Metrics, row, order_by: Sequence[str]
) -> list[Chart]:
    if not column.present:
        return []
    recommended, others = row["chart"], tuple(row["alternatives"])
    if column.kind == "numeric":
        kinds = NUMERIC_CHARTS if column.is_measured else ()
    elif column.kind == "categorical":
        kinds = CATEGORY_CHARTS
    else:
        kinds = ("line",) if column.kind == "date" else ()
    if column.kind == "date":
        return [_column_chart(df, column, metrics, "line", True, others, order_by)]
    return [
        _column_chart(
            df, column, metrics, kind, kind == recommended, others if kind == recommended else (),
            order_by,
        )
        for kind in kinds
        if kind == recommended or kind in others
    ]


def _column_chart(
    df: DataFrame,
    column: ColumnType,
    metrics: Metrics,
    kind: str,
    recommended: bool,
    others: tuple[str, ...],
    order_by: Sequence[str],
) -> Chart:
    name = column.name
    builders: dict[str, tuple[str, Callable[[], DataFrame]]] = {
        "histogram": ("Distribution", lambda: histogram_data(df, column, metrics)),
        "boxplot": ("Boxplot", lambda: box_data(df, column, metrics, order_by)),
        "violin": ("Violin", lambda: violin_data(df, column)),
        "line": ("Trend", lambda: index_line(df, column, order_by)),
        "bar": ("Frequency", lambda: bar_data(df, column)),
        "lollipop": ("Ranking", lambda: lollipop_data(df, column)),
        "pie": ("Composition", lambda: pie_data(df, column)),
        "donut": ("Composition", lambda: pie_data(df, column)),
        "treemap": ("Treemap", lambda: bar_data(df, column, TREEMAP_TOP)),
    }
    if column.kind == "date":
        builders["line"] = ("Timeline", lambda: timeline(df, column))
    subject, build = builders[kind]
    parts = {}
    if kind == "violin":
        parts["box"] = lambda: box_data(df, column, metrics, order_by)
    return Chart(
        f"{kind}_{name}", kind, kind, f"{name} — {subject}", name, None, build, recommended, others,
        distribution=distribution_tag(metrics) if kind == "histogram" else "", parts=parts,
    )


def _pair_chart(
    df: DataFrame,
    x: ColumnType,
    y: ColumnType,
    row,
    order_by: Sequence[str],
    sample: SharedSample,
) -> Chart:
    roles, built = row["roles"], row["built"]
    category, number = (y, x) if roles == "number_category" else (x, y)
    kind = roles if roles in ("date", "numbers", "categories") else "grouped"
    chart = _build_pair(df, x, y, category, number, kind, built, order_by, GROUP_ROWS, sample)
    chart.key = f"{row['chart']}_{x.name}__{y.name}"
    chart.chosen = row["chart"]
    chart.alternatives = tuple(row["alternatives"])
    if kind == "numbers":
        chart.correlation = row["r"]
    return chart


def _build_pair(
    df: DataFrame,
    x: ColumnType,
    y: ColumnType,
    category: ColumnType,
    number: ColumnType,
    kind: str,
    built: str,
    order_by: Sequence[str],
    min_rows: int,
    sample: SharedSample | None = None,
) -> Chart:
    parts: dict[str, Callable[[], DataFrame]] = {}
    first, second = x.name, y.name
    title = f"{x.name} × {y.name}"
    if kind == "date":
        date, other = (x, y) if x.kind == "date" else (y, x)
        first, second, title = date.name, other.name, f"{other.name} over {date.name}"

        def build() -> DataFrame:
            return dated_values(df, date, other, order_by)

    elif kind == "numbers" and built == "line":
        title = f"{y.name} over {x.name}"

        def build() -> DataFrame:
            return xy_line(df, x, y)

    elif kind == "numbers":
        title = f"{x.name} vs {y.name}"

        def source() -> DataFrame:
            return sample.source(x, y) if sample else df

        def build() -> DataFrame:
            return scatter_data(source(), x, y, order_by).select("x", "y")

        parts["trendline"] = lambda: line_fit(scatter_data(source(), x, y, order_by))
        parts["outliers"] = lambda: scatter_outlier_data(source(), x, y, order_by)
    elif kind == "categories":
        if built == "heatmap":
            title += " — Heatmap"

        def build() -> DataFrame:
            pairs = label_pairs(df, x, y)
            return category_heatmap(pairs) if built == "heatmap" else crosstab(pairs, STACK_X, STACK_Y)

    else:
        first, second = category.name, number.name
        title = (
            f"{number.name} by {category.name}"
            if built in ("boxplot", "violin")
            else f"Mean {number.name} by {category.name}"
        )
        values = grouped(df, category, number)

        def ordered() -> DataFrame:
            return grouped(df, category, number, order_by)

        builders = {
            "bar": lambda: grouped_bar_data(values, min_rows),
            "lollipop": lambda: grouped_lollipop_data(values, min_rows),
            "boxplot": lambda: grouped_box_data(ordered(), order_by, min_rows),
            "violin": lambda: grouped_violin_data(values, min_rows),
            "heatmap": lambda: grouped_heatmap_data(values, min_rows),
        }
        build = builders[built]
        if built == "violin":
            parts["box"] = lambda: grouped_box_data(ordered(), order_by, min_rows)
    return Chart(f"{built}_{first}__{second}", built, built, title, first, second, build, parts=parts)


def single_chart(
    df: DataFrame,
    types: Sequence[ColumnType],
    metrics: Sequence[Metrics],
    col_x: str,
    col_y: str | None,
    kind: str,
    order_by: Sequence[str] = (),
) -> Chart | None:
    """The chart asked for, or ``None`` if the columns cannot be shown that way.

    Unlike the chosen charts, discrete numbers are not taken as categories here and small
    groups are kept.
    """
    by_name = {c.name: c for c in types}
    x = by_name[col_x]
    if col_y is None:
        allowed = {"numeric": NUMERIC_CHARTS, "categorical": CATEGORY_CHARTS}.get(x.kind, ())
        if kind not in allowed or not x.present or (x.kind == "numeric" and not x.is_measured):
            return None
        facts = next(m for m in metrics if m["column"] == col_x)
        chart = _column_chart(df, x, facts, kind, False, (), order_by)
        chart.distribution = ""
        return chart
    y = by_name[col_y]
    if _complete_rows(df, [(x, y)])[0] < SINGLE_ROWS:
        return None
    plan = _single_pair(x, y, kind)
    if plan is None:
        return None
    category, number, group, built = plan
    needed = [x, y] if group == "numbers" else [number] if group == "grouped" else []
    if needed and not all(_has_numbers(df, c, x, y) for c in needed):
        return None
    chart = _build_pair(df, x, y, category, number, group, built, order_by, 1)
    chart.recommended = False
    return chart


def _single_pair(
    x: ColumnType, y: ColumnType, kind: str
) -> tuple[ColumnType, ColumnType, str, str] | None:
    """(category, number, kind of pair, chart to build) for a chart asked for."""
    x_is_category = x.kind == "categorical"
    both_categories = x_is_category and y.kind == "categorical"
    category, number = (x, y) if x_is_category else (y, x)
    if kind in ("line", "area") and "date" in (x.kind, y.kind):
        return category, number, "date", kind
    if kind == "scatter" or (kind == "line" and x.kind == y.kind == "numeric"):
        return category, number, "numbers", kind
    if kind in ("grouped_bar", "bar"):
        return category, number, "grouped", "bar"
    if kind in ("lollipop", "boxplot", "violin"):
        return category, number, "grouped", kind
    if kind in ("stacked_bar", "heatmap") and both_categories:
        return category, number, "categories", kind
    if kind == "heatmap" and x_is_category:
        return category, number, "grouped", kind
    return None


def _has_numbers(df: DataFrame, column: ColumnType, x: ColumnType, y: ColumnType) -> bool:
    complete = df.where(_shown_value(x).isNotNull() & _shown_value(y).isNotNull())
    return bool(complete.select(column.number.alias("v")).dropna().head(1))


def chart_catalogue(df: DataFrame, charts: Mapping[str, Chart]) -> DataFrame:
    """One row per chart, without its data."""
    rows = [
        (
            c.key, c.chosen, c.built, c.title, c.col_x, c.col_y, c.priority, c.recommended,
            list(c.alternatives), c.correlation, c.distribution,
        )
        for c in charts.values()
    ]
    return small_table(
        df.sparkSession,
        rows,
        "key string, chosen string, built string, title string, col_x string, col_y string,"
        " priority string, recommended boolean, alternatives array<string>, correlation double,"
        " distribution string",
    )


__all__ = ["ALTERNATIVES", "Chart", "chart_catalogue", "report_charts", "single_chart"]

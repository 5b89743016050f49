"""One row of statistics per column.

``column_metrics`` runs the passes and returns exact numbers per column (at most a few
hundred short rows); ``profile_frame`` turns them into the rounded, classified profile.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulens.batching import batches
from tabulens.functions.dates import cadence
from tabulens.functions.numbers import rounded
from tabulens.functions.text import is_blank
from tabulens.operators.accumulate import column_facts
from tabulens.operators.bins import column_spread
from tabulens.operators.frequency import (
    category_metrics,
    mode_metrics,
    number_counts,
    to_long,
    value_counts,
)
from tabulens.operators.gaps import date_summary
from tabulens.operators.moments import text_lengths
from tabulens.operators.ordinal import monotonic_flags
from tabulens.operators.quantiles import (
    DIRECT_ROWS,
    column_quantiles,
    quantile_array,
    running_counts,
)
from tabulens.plans.sketches import sketch, sketched_profile
from tabulens.plans.types import ColumnType, detect_types
from tabulens.session import small_table

Metrics = dict[str, Any]

PROBABILITIES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
QUANTILE_NAMES = ("p05", "p10", "q1", "median", "q3", "p90", "p95")

RAW_SCHEMA = (
    "column string, position int, type string, total bigint, missing bigint,"
    " mean double, median double, mode double, std double,"
    " min double, max double, q1 double, q3 double, p05 double, p10 double, p90 double,"
    " p95 double, skewness double, kurtosis double, outliers_iqr bigint, outliers_z bigint,"
    " monotonic_inc boolean, monotonic_dec boolean, numeric_entropy double,"
    " zero_count bigint, negative_count bigint, n_valid bigint, n_unique_vals bigint,"
    " all_integers boolean,"
    " unique_count bigint, cardinality_ratio double, dominant_value string,"
    " dominant_rate double, categorical_entropy double, normalised_entropy double,"
    " balance_score double, gini_impurity double, top_values array<string>,"
    " top_counts array<bigint>, top_pcts array<double>,"
    " first timestamp_ntz, last timestamp_ntz, range_days bigint, unique_dates bigint,"
    " input_is_sorted boolean,"
    " median_gap_days double, regularity_pct double,"
    " avg_length double, median_length double, max_length bigint, min_length bigint,"
    " blank_count bigint"
)


def profile(df: DataFrame, order_by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Profile of every column; ``order_by`` gives the rows their order.

    With ``exact=False`` it is estimated from mergeable sketches, in one scan (see sketches.py).
    """
    if not exact:
        return sketched_profile(sketch(df, order_by))
    return profile_frame(df.sparkSession, column_metrics(df, order_by))


def column_metrics(
    df: DataFrame,
    order_by: Sequence[str] = (),
    types: Sequence[ColumnType] | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> list[Metrics]:
    """Unrounded metrics, one dictionary per column."""
    types = detect_types(df, order_by) if types is None else types
    out: dict[int, Metrics] = {
        c.pos: {
            "column": c.name,
            "position": c.pos,
            "type": c.kind,
            "total": c.total,
            "missing": c.total - c.present,
        }
        for c in types
    }
    kinds: dict[str, list[ColumnType]] = {}
    for c in types:
        if c.present:
            kinds.setdefault(c.kind, []).append(c)
    measured = [c for c in kinds.get("numeric", []) if c.is_measured]
    for batch in batches(measured):
        _merge(out, numeric_metrics(df, batch, direct_rows))
    for kind, compute in (
        ("categorical", categorical_metrics),
        ("date", date_metrics),
        ("text", text_metrics),
    ):
        for batch in batches(kinds.get(kind, [])):
            _merge(out, compute(df, batch))
    # numbers and dates share one sort of the rows
    ordered = [c for c in measured if "mean" in out[c.pos]] + kinds.get("date", [])
    for batch in batches(ordered):
        _merge(out, order_metrics(df, batch, order_by))
    return [out[c.pos] for c in types]


def _merge(out: dict[int, Metrics], metrics: dict[int, Metrics]) -> None:
    for pos, values in metrics.items():
        out[pos].update(values)


def _by_position(frame: DataFrame) -> dict[int, Metrics]:
    rows = [row.asDict() for row in frame.collect()]
    return {row.pop("pos"): row for row in rows}


def numeric_metrics(
    df: DataFrame,
    columns: Sequence[ColumnType],
    direct_rows: int = DIRECT_ROWS,
) -> dict[int, Metrics]:
    """Passes over the numeric columns: value counts; spread.

    The moments come from the scan that found the types; columns without it are scanned here.
    """
    if not columns:
        return {}
    found = {c.pos: c.facts.moments() for c in columns if c.facts}
    unseen = {c.pos: {"number": c.number} for c in columns if not c.facts}
    if unseen:
        found |= {pos: facts.moments() for pos, facts in column_facts(df, unseen).items()}
    found = {p: m for p, m in found.items() if m["n_valid"] >= 2}
    if not found:
        return {}
    numbers = {c.pos: c.number for c in columns if c.pos in found}
    sizes = {pos: m["n_valid"] for pos, m in found.items()}
    counts = number_counts(df, numbers)
    if max(sizes.values()) <= direct_rows:
        # one sort of the value counts gives quantiles, mode and distinct values
        per_column = running_counts(counts, sizes).groupBy("pos")
        counted = _by_position(
            per_column.agg(quantile_array(PROBABILITIES).alias("q"), *mode_metrics())
        )
    else:
        counted = _by_position(counts.groupBy("pos").agg(*mode_metrics()))
        quantiles = column_quantiles(df, numbers, PROBABILITIES, sizes, direct_rows)
        _merge(counted, {pos: {"q": q} for pos, q in quantiles.items()})
    for pos, metrics in counted.items():
        found[pos].update(zip(QUANTILE_NAMES, metrics.pop("q")))
        found[pos].update(metrics)
    _merge(found, _by_position(column_spread(df, numbers, found)))
    return found


def order_metrics(
    df: DataFrame, columns: Sequence[ColumnType], order_by: Sequence[str] = ()
) -> dict[int, Metrics]:
    """Whether numbers rise or fall, and whether dates are sorted, in row order."""
    if not columns:
        return {}
    dates = {c.pos for c in columns if c.kind == "date"}
    values = {c.pos: c.timestamp if c.pos in dates else c.number for c in columns}
    flags = monotonic_flags(df, values, order_by)
    return {
        pos: {"input_is_sorted": rising}
        if pos in dates
        else {"monotonic_inc": rising, "monotonic_dec": falling}
        for pos, (rising, falling) in flags.items()
    }


def categorical_metrics(df: DataFrame, columns: Sequence[ColumnType]) -> dict[int, Metrics]:
    """From the values that the type scan listed; other columns are counted here."""
    listed = {c.pos: c.facts.texts() if c.facts else None for c in columns}
    unlisted = {c.pos: c.text for c in columns if listed[c.pos] is None}
    rows = [(pos, text, n) for pos, texts in listed.items() for text, n in (texts or {}).items()]
    found = {}
    if rows:
        counts = small_table(df.sparkSession, rows, "pos int, value string, n bigint")
        found |= _by_position(category_metrics(counts))
    if unlisted:
        counts = value_counts(to_long(df, unlisted), "pos", "value")
        found |= _by_position(category_metrics(counts))
    return found


def date_metrics(df: DataFrame, columns: Sequence[ColumnType]) -> dict[int, Metrics]:
    if not columns:
        return {}
    return _by_position(date_summary(to_long(df, {c.pos: c.timestamp for c in columns})))


def text_metrics(df: DataFrame, columns: Sequence[ColumnType]) -> dict[int, Metrics]:
    if not columns:
        return {}

    def measure(text: Column) -> Column:
        shape = F.struct(F.length(text).alias("length"), is_blank(text).alias("blank"))
        return F.when(text.isNotNull(), shape)

    shapes = to_long(df, {c.pos: measure(c.text) for c in columns}, "shape")
    found = _by_position(
        text_lengths(
            shapes.select(
                "pos", F.col("shape.length").alias("value"), F.col("shape.blank").alias("blank")
            )
        )
    )
    for c in columns:
        if c.pos in found:
            found[c.pos]["unique_count"] = c.n_unique
    return found


def profile_frame(spark: SparkSession, metrics: Iterable[Metrics]) -> DataFrame:
    """The profile as a DataFrame: rounded metrics, classifications, NULL where unused."""
    names = [field.split()[0] for field in RAW_SCHEMA.split(", ")]
    rows = [tuple(m.get(name) for name in names) for m in metrics]
    raw = small_table(spark, rows, RAW_SCHEMA)
    return raw.select(*_profile_columns())


def _profile_columns() -> list[Column]:
    c = F.col
    measured = c("mean").isNotNull()
    relative = c("std") / F.nullif(F.abs("mean"), F.lit(0.0))
    skew, kurt = F.abs("skewness"), F.abs("kurtosis")
    near_normal = F.coalesce((skew < 0.5) & (kurt < 1), F.lit(False))
    share = c("n_unique_vals") / c("n_valid")
    few_values = (c("n_unique_vals") <= 100) | (share < 0.10)

    def r(name: str, digits: int = 4) -> Column:
        return rounded(c(name), digits).alias(name)

    return [
        c("column"),
        c("position"),
        c("type"),
        c("total"),
        c("missing"),
        F.when(c("total") > 0, F.round(c("missing") / c("total") * 100, 2))
        .otherwise(0.0)
        .alias("missing_rate"),
        r("mean"),
        r("median"),
        r("mode"),
        r("std"),
        rounded(c("std") * c("std")).alias("variance"),
        rounded(relative * 100).alias("cv_pct"),
        r("min"),
        r("max"),
        rounded(c("max") - c("min")).alias("range"),
        r("q1"),
        r("q3"),
        rounded(c("q3") - c("q1")).alias("iqr"),
        r("p05"),
        r("p10"),
        r("p90"),
        r("p95"),
        r("skewness"),
        r("kurtosis"),
        F.when(
            measured,
            F.when(c("skewness") > 1, "right_skewed")
            .when(c("skewness") < -1, "left_skewed")
            .otherwise("symmetric"),
        ).alias("skew_type"),
        F.when(
            measured,
            F.when(near_normal, "normal_like").when(skew < 1, "mild_skew").otherwise("highly_skewed"),
        ).alias("distribution"),
        F.when(measured, near_normal).alias("is_normal_like"),
        c("outliers_iqr"),
        c("outliers_z"),
        F.round(c("outliers_iqr") / c("n_valid") * 100, 2).alias("outlier_ratio"),
        (c("monotonic_inc") | c("monotonic_dec")).alias("monotonic"),
        c("monotonic_inc"),
        c("monotonic_dec"),
        r("numeric_entropy"),
        rounded(relative * relative).alias("variance_score"),
        c("zero_count"),
        c("negative_count"),
        c("n_valid"),
        c("n_unique_vals"),
        F.when(measured, c("all_integers") & few_values).alias("is_discrete"),
        c("unique_count"),
        r("cardinality_ratio"),
        c("dominant_value"),
        r("dominant_rate", 2),
        r("categorical_entropy"),
        r("normalised_entropy"),
        r("balance_score"),
        r("gini_impurity"),
        c("top_values"),
        c("top_counts"),
        c("top_pcts"),
        F.date_format("first", "yyyy-MM-dd").alias("min_date"),
        F.date_format("last", "yyyy-MM-dd").alias("max_date"),
        c("range_days"),
        c("unique_dates"),
        F.when(c("unique_dates").isNotNull(), True).alias("is_sorted"),
        c("input_is_sorted"),
        r("median_gap_days"),
        cadence(c("median_gap_days")).alias("inferred_freq"),
        r("regularity_pct", 1),
        r("avg_length"),
        r("median_length"),
        c("max_length"),
        c("min_length"),
        c("blank_count"),
        rounded(c("blank_count") / c("n_valid") * 100).alias("blank_rate"),
    ]


def quality_summary(prof: DataFrame) -> DataFrame:
    """Dataset counts: rows, columns per type, missing cells, complete columns."""
    cells = F.sum("total")
    return prof.agg(
        F.max("total").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        *[
            F.count_if(F.col("type") == kind).alias(f"{kind}_columns")
            for kind in ("numeric", "categorical", "date", "text")
        ],
        F.sum("missing").alias("total_missing_cells"),
        F.when(cells > 0, F.round(F.sum("missing") / cells * 100, 2))
        .otherwise(0.0)
        .alias("overall_missing_pct"),
        F.count_if(F.col("missing") == 0).alias("complete_columns"),
    )

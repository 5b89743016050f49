"""The whole analysis of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabulens.functions.numbers import plain_number
from tabulens.functions.text import named
from tabulens.plans.charts import Chart, chart_catalogue, correlations, report_charts, single_chart
from tabulens.plans.features import (
    Feature,
    add_features,
    feature_catalogue,
    suggest_features,
)
from tabulens.plans.importance import score_columns
from tabulens.plans.insights import find_insights
from tabulens.plans.profile import Metrics, column_metrics, profile_frame, quality_summary
from tabulens.plans.types import ColumnType, detect_types
from tabulens.session import small_table

PREVIEW_ROWS, FEATURE_ROWS = 10, 5_000


@dataclass(frozen=True)
class Report:
    """Everything found out about a table. All parts but ``table`` and ``features`` are small."""

    table: DataFrame
    order_by: tuple[str, ...]
    types: list[ColumnType]
    metrics: list[Metrics]
    profile: DataFrame
    quality: DataFrame
    importance: DataFrame
    correlations: DataFrame
    insights: DataFrame
    charts: Mapping[str, Chart]
    suggestions: list[Feature]

    @property
    def features(self) -> DataFrame:
        """The table with its suggested columns."""
        return add_features(self.table, self.suggestions)

    @property
    def feature_values(self) -> DataFrame:
        """The suggested columns of the first 5,000 rows."""
        names = [named(f.name) for f in self.suggestions]
        return first_rows(self.features, self.order_by, FEATURE_ROWS).select(*names)

    @property
    def preview(self) -> DataFrame:
        return preview(self.table, self.order_by)

    def chart(self, col_x: str, col_y: str | None, kind: str) -> Chart:
        """A chart of the caller's choice."""
        for name in (col_x, col_y):
            if name is not None and name not in self.table.columns:
                raise ValueError(f"Column '{name}' not found.")
        chart = single_chart(
            self.table, self.types, self.metrics, col_x, col_y, kind, self.order_by
        )
        if chart is None:
            raise ValueError(f"Cannot generate '{kind}' for this column combination.")
        return chart

    def digest(self, name: str = "dataset") -> DataFrame:
        return digest(self.profile, self.importance, name)

    def frames(self) -> dict[str, DataFrame]:
        """The small parts by name, ready to be written."""
        spark = self.table.sparkSession
        return {
            "profile": self.profile,
            "quality": self.quality,
            "importance": self.importance,
            "insights": self.insights,
            "charts": chart_catalogue(self.table, self.charts),
            "features": feature_catalogue(spark, self.suggestions),
            "preview": self.preview,
        }


def full_report(df: DataFrame, order_by: Sequence[str] = ()) -> Report:
    """Profile, importance, charts, findings and derived columns of ``df``.

    ``df`` is read several times, each time only in the columns needed; persist it first
    if reading is costly. ``order_by`` names the columns that give the rows their order.
    """
    types = detect_types(df, order_by)
    if not types or types[0].total == 0:
        raise ValueError("The table is empty.")
    metrics = column_metrics(df, order_by, types)
    prof = profile_frame(df.sparkSession, metrics)
    importance = score_columns(prof)
    pairs = _collected(correlations(df, types))
    return Report(
        table=df,
        order_by=tuple(order_by),
        types=types,
        metrics=metrics,
        profile=prof,
        quality=quality_summary(prof),
        importance=importance,
        correlations=pairs,
        insights=find_insights(prof, importance, pairs),
        charts=report_charts(df, types, metrics, pairs, order_by),
        suggestions=suggest_features(types, metrics),
    )


def _collected(pairs: DataFrame) -> DataFrame:
    """The correlations, computed once: one row per pair of numeric columns."""
    rows = [(r["pos_a"], r["pos_b"], r["r"], r["n"]) for r in pairs.collect()]
    return small_table(pairs.sparkSession, rows, "pos_a int, pos_b int, r double, n bigint")


def preview(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ten rows."""
    return first_rows(df, order_by, PREVIEW_ROWS)


def first_rows(df: DataFrame, order_by: Sequence[str], rows: int) -> DataFrame:
    """Each task keeps only its own first rows."""
    return (df.orderBy(*[named(key) for key in order_by]) if order_by else df).limit(rows)


def digest(prof: DataFrame, importance: DataFrame, name: str = "dataset") -> DataFrame:
    """One row with a short text about the table, a line per column."""
    labels = importance.select("column", "label")
    rows = prof.join(F.broadcast(labels), "column", "left")
    lines = rows.select("position", "total", _digest_line().alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("position", "line")))
    body = F.array_join(F.transform(ordered, lambda entry: entry["line"]), "\n")
    head = F.format_string(
        "Dataset: %s, %s rows, %s columns\n\n",
        F.lit(name),
        F.max("total").cast("string"),
        F.count(F.lit(1)).cast("string"),
    )
    return lines.agg(F.concat(head, body).alias("digest"))


def _or_none(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def _digest_line() -> Column:
    c = F.col
    head = F.concat(
        F.lit("  "), c("column"), F.lit(" ["), c("type"), F.lit(", importance="),
        F.coalesce("label", F.lit("?")), F.lit("]"),
    )
    numeric = F.concat(
        F.lit(": mean="), plain_number(c("mean")), F.lit(", std="), plain_number(c("std")),
        F.lit(", skew="), plain_number(c("skewness")), F.lit(", outlier%="),
        plain_number(c("outlier_ratio")), F.lit(", missing%="), plain_number(c("missing_rate")),
    )
    categorical = F.concat(
        F.lit(": "), _or_none(c("unique_count")), F.lit(" unique, top='"),
        _or_none(c("dominant_value")), F.lit("' ("), plain_number(c("dominant_rate")),
        F.lit("%), entropy="), plain_number(c("categorical_entropy")),
    )
    dates = F.concat(
        F.lit(": "), _or_none(c("min_date")), F.lit(" → "), _or_none(c("max_date")),
        F.lit(", freq="), _or_none(c("inferred_freq")),
    )
    return F.concat(
        head,
        F.when(c("type") == "numeric", numeric)
        .when(c("type") == "categorical", categorical)
        .when(c("type") == "date", dates)
        .otherwise(""),
    )

"""Suggested derived columns, as a catalogue and as real columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulens.functions.dates import day_of_week, is_weekend
from tabulens.functions.numbers import quartile_label, ratio, rounded, square_root, standard_score
from tabulens.functions.text import slug
from tabulens.operators.frequency import frequency_encode
from tabulens.plans.profile import Metrics
from tabulens.plans.types import ColumnType
from tabulens.session import small_table

# Limits, and the name parts that suggest a ratio of two columns.
MOST_FEATURES = 20
VALUE_DIGITS = 6
MATCHES_PER_SIDE = 2
RATIO_HINTS = (
    (("revenue", "sales", "income", "profit"), ("cost", "expense", "spend")),
    (("clicks", "conversions", "sales"), ("visits", "views", "impressions", "sessions")),
    (("profit", "net"), ("revenue", "gross", "sales")),
)


@dataclass(frozen=True)
class Feature:
    """A derived column: ``value`` is its expression; a frequency needs a join instead."""

    name: str
    source_cols: tuple[str, ...]
    transform: str
    reason: str
    value: Column | None = None


def suggest_features(
    types: Sequence[ColumnType], metrics: Sequence[Metrics]
) -> list[Feature]:
    """The first 20 suggestions: numbers, dates, categories, then ratios of columns."""
    facts = {m["column"]: m for m in metrics}
    found: dict[str, Feature] = {}
    for make in (_numeric, _dates, _categories, _ratios):
        for feature in make(types, facts):
            found.setdefault(feature.name, feature)
    # names are compared as Spark does, without case
    taken = {c.name.lower() for c in types}
    out = []
    for feature in list(found.values())[:MOST_FEATURES]:
        name, number = feature.name, 2
        while name.lower() in taken:
            name, number = f"{feature.name}_{number}", number + 1
        taken.add(name.lower())
        out.append(replace(feature, name=name))
    return out


def _shown(metrics: Metrics, name: str, digits: int = 4) -> float:
    """A metric as the profile shows it, 0 if it has none."""
    value = metrics.get(name)
    return 0.0 if value is None else round(value, digits)


def _cv(metrics: Metrics) -> float:
    mean, std = metrics.get("mean"), metrics.get("std")
    return round(std / abs(mean) * 100, 4) if mean and std is not None else 0.0


# Conditions and texts below are fixed values.


def _numeric(
    types: Sequence[ColumnType], facts: Mapping[str, Metrics]
) -> Iterator[Feature]:
    for c in types:
        if c.kind != "numeric":
            continue
        m, name, own = facts[c.name], slug(c.name), (c.name,)
        skew, cv, n = _shown(m, "skewness"), _cv(m), m.get("n_valid") or 0
        if skew >= 0.5 and _shown(m, "min") >= 0:
            if skew >= 1:
                reason = f"'{c.name}' is right-skewed (skewness={skew:.2f}); log1p compresses the tail."
                yield Feature(f"log1p_{name}", own, "log1p", reason, F.log1p(c.number))
            else:
                reason = f"'{c.name}' has moderate right skew ({skew:.2f}); square-root softens it."
                yield Feature(f"sqrt_{name}", own, "sqrt", reason, square_root(c.number))
        if cv > 50 and n > 5 and m["std"] > 0:
            reason = (
                f"'{c.name}' has high variability (CV={cv:.0f}%); "
                "z-score standardises it for fair comparison."
            )
            z = standard_score(c.number, m["mean"], m["std"])
            yield Feature(f"zscore_{name}", own, "z_score", reason, z)
        if n >= 20:
            edges = [m[edge] for edge in ("min", "q1", "median", "q3", "max")]
            if len(set(edges)) == len(edges):
                reason = f"'{c.name}' binned into quartiles — useful for segmentation analysis."
                label = quartile_label(c.number, *edges[1:4])
                yield Feature(f"bin_{name}", own, "quartile_bin", reason, label)


def _dates(types: Sequence[ColumnType], facts: Mapping[str, Metrics]) -> Iterator[Feature]:
    for c in types:
        if c.kind != "date" or not facts[c.name].get("n_valid"):
            continue
        ts, of = c.timestamp, f"'{c.name}'"
        parts = (
            ("year", F.year(ts), f"Year extracted from {of} — enables year-over-year comparison."),
            (
                "month",
                F.month(ts),
                f"Month (1–12) extracted from {of} — useful for seasonality analysis.",
            ),
            (
                "dayofweek",
                day_of_week(ts),
                f"Day of week (0=Mon … 6=Sun) from {of} — detects weekly patterns.",
            ),
            ("quarter", F.quarter(ts), f"Quarter (1–4) from {of} — enables quarterly trend analysis."),
            (
                "is_weekend",
                is_weekend(ts),
                f"Weekend flag (1/0) from {of} — useful for behaviour segmentation.",
            ),
        )
        for part, value, reason in parts:
            transform = part if part == "is_weekend" else f"extract_{part}"
            name = f"{slug(c.name)}_{part}"
            yield Feature(name, (c.name,), transform, reason, value.cast("double"))


def _categories(
    types: Sequence[ColumnType], facts: Mapping[str, Metrics]
) -> Iterator[Feature]:
    for c in types:
        m = facts[c.name]
        if c.kind != "categorical" or (m.get("unique_count") or 0) < 3:
            continue
        advice = (
            "Recommended for high-cardinality column."
            if _shown(m, "cardinality_ratio") > 0.3
            else "Useful as a numeric proxy."
        )
        reason = (
            f"Frequency encoding of '{c.name}' — replaces each category with its row count. {advice}"
        )
        yield Feature(f"freq_{slug(c.name)}", (c.name,), "frequency_encode", reason)


def _ratios(types: Sequence[ColumnType], facts: Mapping[str, Metrics]) -> Iterator[Feature]:
    numbers = [
        c
        for c in types
        if c.kind == "numeric"
        and _shown(facts[c.name], "min") >= 0
        and (facts[c.name].get("n_valid") or 0) > 5
    ]

    def matches(hints: Sequence[str]) -> list[ColumnType]:
        named = [c for c in numbers if any(hint in c.name.lower() for hint in hints)]
        return named[:MATCHES_PER_SIDE]

    seen: set[frozenset[str]] = set()
    for over, under in RATIO_HINTS:
        for n, d in product(matches(over), matches(under)):
            pair = frozenset((n.name, d.name))
            if n.name == d.name or pair in seen:
                continue
            seen.add(pair)
            yield Feature(
                f"ratio_{slug(n.name)}_per_{slug(d.name)}",
                (n.name, d.name),
                "ratio",
                f"Ratio of '{n.name}' ÷ '{d.name}' — captures efficiency or conversion rate.",
                ratio(n.number, d.number),
            )


def feature_catalogue(spark: SparkSession, features: Sequence[Feature]) -> DataFrame:
    """(seq, name, source_cols, transform, reason), without values."""
    rows = [
        (i, f.name, list(f.source_cols), f.transform, f.reason) for i, f in enumerate(features)
    ]
    return small_table(
        spark, rows, "seq int, name string, source_cols array<string>, transform string, reason string"
    )


def add_features(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """The table with all suggested columns for all its rows, numbers to six places.

    Everything but frequencies is a projection; frequencies join a small lookup each.
    """
    computed = []
    for f in features:
        if f.value is not None:
            label = f.transform == "quartile_bin"
            computed.append((f.value if label else rounded(f.value, VALUE_DIGITS)).alias(f.name))
    out = df.select("*", *computed)
    for f in features:
        if f.value is None:
            out = frequency_encode(out, f.source_cols[0], f.name)
    return out

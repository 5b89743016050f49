"""Column importance: weighted signals, scaled to 0-10 over the table, in three tiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabulens.functions.numbers import or_zero
from tabulens.functions.text import fixed

# Lower bounds of the tiers.
IMPORTANT, MODERATE = 6.0, 3.0


@dataclass(frozen=True)
class Step:
    """What one outcome of a signal is worth and, if notable, how it reads."""

    when: Column
    points: float
    reason: Column | None = None


Signal = Sequence[Step]


def score_columns(prof: DataFrame) -> DataFrame:
    """(column, position, type, score, label, missing_rate, reasons) from the profile.

    One projection over a frame with one row per column.
    """
    signals = _all_signals()
    points = F.lit(0.0)
    for signal in signals:
        points = points + _first(signal, [F.lit(step.points) for step in signal], F.lit(0.0))
    no_reason = F.lit(None).cast("string")
    reasons = F.array(
        *[_first(s, [no_reason if x.reason is None else x.reason for x in s], no_reason) for s in signals]
    )
    raw = prof.select(
        "column",
        "position",
        "type",
        "missing_rate",
        points.alias("raw"),
        F.array_compact(reasons).alias("reasons"),
    )
    low, high = raw.agg(F.min("raw")).scalar(), raw.agg(F.max("raw")).scalar()
    span = F.when(high == low, 1.0).otherwise(high - low)
    scaled = raw.withColumn("score", F.round((F.col("raw") - low) / span * 10, 2) + F.lit(0.0))
    return scaled.select(
        "column", "position", "type", "score", tier(F.col("score")).alias("label"), "missing_rate",
        "reasons",
    )


def tier(score: Column) -> Column:
    return (
        F.when(score >= IMPORTANT, "important").when(score >= MODERATE, "moderate").otherwise("low")
    )


def _first(signal: Signal, outcomes: Sequence[Column], otherwise: Column) -> Column:
    """The outcome of the first step that applies."""
    chain = F.when(signal[0].when, outcomes[0])
    for step, outcome in zip(signal[1:], outcomes[1:]):
        chain = chain.when(step.when, outcome)
    return chain.otherwise(otherwise)


def _all_signals() -> list[Signal]:
    by_type = {
        "numeric": _numeric_signals(),
        "categorical": _categorical_signals(),
        "date": _date_signals(),
    }
    signals: list[Signal] = [_missing_signal()]
    for kind, group in by_type.items():
        applies = F.col("type") == kind
        signals += [[Step(applies & s.when, s.points, s.reason) for s in signal] for signal in group]
    untyped = ~F.col("type").isin(*by_type)
    signals.append([Step(untyped, -1.0, F.lit("Free-text column (low analytical value)"))])
    return signals


# Thresholds, points and reason texts below are fixed values.


def _missing_signal() -> Signal:
    rate = F.col("missing_rate")
    shown = F.concat(F.lit(" ("), fixed(rate), F.lit("%)"))
    return [
        Step(rate >= 80, -4.0, F.concat(F.lit("Mostly missing"), shown)),
        Step(rate >= 50, -2.5, F.concat(F.lit("High missing rate"), shown)),
        Step(rate >= 20, -1.0, F.concat(F.lit("Notable missing values"), shown)),
        Step(rate > 0, -0.2),
    ]


def _numeric_signals() -> list[Signal]:
    cv, entropy = or_zero(F.col("cv_pct")), or_zero(F.col("numeric_entropy"))
    skew, kurt = F.abs(or_zero(F.col("skewness"))), F.abs(or_zero(F.col("kurtosis")))
    outliers, n = or_zero(F.col("outlier_ratio")), F.coalesce("n_valid", F.lit(0))
    shown = F.concat(F.lit(" ("), fixed(outliers, 1), F.lit("%)"))
    return [
        [Step(F.lit(True), 2.0)],
        [
            Step(cv > 100, 2.5, F.lit("Very high variability (CV > 100%)")),
            Step(cv > 30, 1.5, F.lit("High variability")),
            Step(cv < 1, -2.0, F.lit("Near-constant values (low variance)")),
        ],
        [
            Step(skew >= 2, 1.0, F.lit("Highly skewed — potential for transformation")),
            Step(skew > 0.3, 0.5, F.lit("Moderately skewed distribution")),
        ],
        [Step(kurt > 3, 0.5, F.lit("Heavy tails (high kurtosis)"))],
        [
            Step(entropy > 3.5, 1.5, F.lit("High information content")),
            Step(entropy > 2, 0.5),
        ],
        [
            Step(outliers > 20, -1.5, F.concat(F.lit("Very high outlier density"), shown)),
            Step(outliers > 10, -0.5, F.concat(F.lit("Notable outliers"), shown)),
        ],
        [Step(F.col("monotonic"), 1.0, F.lit("Monotonic trend — good time-series signal"))],
        [Step(n >= 10_000, 0.5), Step(n < 10, -1.0, F.lit("Very few valid values"))],
    ]


def _categorical_signals() -> list[Signal]:
    entropy, balance = or_zero(F.col("normalised_entropy")), or_zero(F.col("balance_score"))
    cardinality, unique = or_zero(F.col("cardinality_ratio")), F.coalesce("unique_count", F.lit(0))
    dominant = F.coalesce(F.nullif(F.col("dominant_rate"), F.lit(0.0)), F.lit(100.0))
    shown = F.concat(F.lit("One value covers "), fixed(dominant), F.lit("% of rows"))
    return [
        [Step(F.lit(True), 1.5)],
        [
            Step(entropy >= 0.85, 2.0, F.lit("Near-uniform distribution (high entropy)")),
            Step(entropy >= 0.55, 1.0, F.lit("Good category diversity")),
            Step(entropy < 0.2, -1.5, F.lit("One dominant category (low entropy)")),
        ],
        [Step(balance > 0.7, 0.5, F.lit("Balanced categories"))],
        [
            Step(cardinality > 0.9, -3.0, F.lit("Almost unique values — effectively an ID column")),
            Step(cardinality > 0.5, -1.5, F.lit("Very high cardinality")),
            Step(unique == 1, -3.0, F.lit("Single value — no variance")),
            Step(unique == 2, 0.5, F.lit("Binary column — clean split")),
        ],
        [Step(dominant > 95, -1.0, shown)],
    ]


def _date_signals() -> list[Signal]:
    regularity, unique = or_zero(F.col("regularity_pct")), F.coalesce("unique_dates", F.lit(0))
    freq = F.col("inferred_freq")
    cadence = F.concat(F.lit("Regular "), freq, F.lit(" cadence"))
    return [
        [Step(F.lit(True), 3.0, F.lit("Temporal column — enables time-series analysis"))],
        [Step(F.col("is_sorted"), 1.0, F.lit("Chronologically ordered"))],
        [Step(freq.isNotNull(), 0.5, cadence)],
        [
            Step(regularity >= 80, 0.5, F.lit("Highly regular intervals")),
            Step(regularity < 40, -0.5, F.lit("Irregular intervals")),
        ],
        [Step(unique < 3, -2.0, F.lit("Too few unique dates"))],
    ]

"""Numeric column expressions. All are built-ins, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Fixed value: what counts as a written number (surrounding blanks allowed).
NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"

# Characters a written number may have; lets long texts fail at their first letter.
NUMBER_CHARACTERS = r"^[\s\d,.eE+-]++$"

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)


def null_non_finite(value: Column) -> Column:
    """NaN and the infinities become NULL."""
    # NaN sorts above infinity, so one comparison removes both
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def is_number_text(text: Column) -> Column:
    """Whether a string is a written number, thousands commas allowed."""
    return text.rlike(NUMBER_CHARACTERS) & _without_commas(text).rlike(NUMBER_PATTERN)


def _without_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def parse_number(text: Column) -> Column:
    """String to double; thousands commas are dropped, anything else unparsable is NULL."""
    number = _without_commas(text).try_cast("double")
    return null_non_finite(F.when(is_number_text(text), number))


def as_number(column: Column, dtype: T.DataType) -> Column:
    """Any column as a finite double, or NULL where it holds no number."""
    if isinstance(dtype, T.FloatType):
        # through text, so that 0.1f is 0.1 and not 0.10000000149
        return null_non_finite(column.cast("string").cast("double"))
    if isinstance(dtype, T.DoubleType):
        return null_non_finite(column)
    if isinstance(dtype, NUMERIC_TYPES):
        return column.cast("double")
    if isinstance(dtype, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(dtype, T.StringType):
        return parse_number(column)
    return F.lit(None).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, NULL where the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def rounded(value: Column, digits: int = 4) -> Column:
    """Round to ``digits``; NULL, NaN and infinities give NULL, and -0.0 gives 0.0."""
    return F.round(null_non_finite(value), digits) + F.lit(0.0)


def or_zero(column: Column) -> Column:
    """A metric that is absent counts as zero."""
    return F.coalesce(column, F.lit(0.0))


def square_root(value: Column) -> Column:
    """Square root with negative values taken as zero."""
    return F.sqrt(F.when(value < 0, F.lit(0.0)).otherwise(value))


def standard_score(value: Column, mean: float, std: float) -> Column:
    return (value - F.lit(mean)) / F.lit(std)


def quartile_label(value: Column, q1: float, median: float, q3: float) -> Column:
    """Q1 to Q4, each interval closed on the right, the lowest value included."""
    return (
        F.when(value <= q1, "Q1")
        .when(value <= median, "Q2")
        .when(value <= q3, "Q3")
        .when(value.isNotNull(), "Q4")
    )


def plain_number(value: Column, digits: int = 4) -> Column:
    """Text of a rounded double without exponent: ``25.4022``, ``3.0``; ``None`` for NULL."""
    fixed = F.round(value, digits).cast(T.DecimalType(38, digits)).cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
    return F.coalesce(trimmed, F.lit("None"))

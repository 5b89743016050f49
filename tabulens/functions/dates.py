"""Date and timestamp expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# Accepted ways to write a date, each with the shape a value must have. The
# first non-null value of a column picks one; the other values must follow the same one.
DATE_FORMATS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-M-d H:mm": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$",
    "yyyy-M-d H:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$",
    "yyyy-M-d H:mm:ss.SSSSSSSSS": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,9}$",
    "yyyy-M-d'T'H:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$",
    "yyyy-M-d'T'H:mm:ssXXX": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}(Z|[-+]\d{2}:\d{2})$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
}

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def parse_date(text: Column, fmt: str) -> Column:
    """String to timestamp; values not written in ``fmt`` are NULL."""
    shaped = F.when(text.rlike(DATE_FORMATS[fmt]), text)
    return F.try_to_timestamp(shaped, F.lit(fmt)).cast("timestamp_ntz")


def as_timestamp(column: Column, dtype: T.DataType, fmt: str | None = None) -> Column:
    """Any date-like column as a timestamp without time zone."""
    if isinstance(dtype, DATE_TYPES):
        return column.cast("timestamp_ntz")
    if fmt is None:
        return F.lit(None).cast("timestamp_ntz")
    return parse_date(column, fmt)


def cadence(median_gap: Column) -> Column:
    """Name of the usual step between consecutive dates, from the median gap in days."""
    return (
        F.when(median_gap <= 1, "daily")
        .when(median_gap <= 8, "weekly")
        .when(median_gap <= 35, "monthly")
        .when(median_gap <= 100, "quarterly")
        .when(median_gap.isNotNull(), "yearly")
    )


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def day_of_week(ts: Column) -> Column:
    """0 is Monday, 6 is Sunday."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    """1 on Saturday and Sunday, else 0; a missing date gives 0."""
    return F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0))


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour days between two timestamps (not the number of midnights)."""
    return F.timestamp_diff("DAY", start, end)


def pick_format(samples: Sequence[dict[str, bool]]) -> str | None:
    """The first format that reads the first sample, provided it reads all of them.

    ``samples`` holds, per value in row order, which formats can read it.
    """
    if not samples:
        return None
    readable = [fmt for fmt in DATE_FORMATS if samples[0].get(fmt)]
    if readable and all(sample.get(readable[0]) for sample in samples):
        return readable[0]
    return None

"""String expressions and name helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Tokens of a text file that mean "no value".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def null_na_tokens(value: Column) -> Column:
    return F.when(~value.isin(*NA_TOKENS), value)


def is_blank(value: Column) -> Column:
    """Nothing but white space (of any kind, not just spaces)."""
    return ~value.rlike(r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}]")


def slug(name: str) -> str:
    """Name fragment: runs of other characters become ``_``; lower case, 30 characters."""
    return re.sub(r"[^a-zA-Z0-9]+", "_", name).strip("_").lower()[:30]


def tidy_name(name: str) -> str:
    """Trim and collapse white space."""
    return re.sub(r"\s+", " ", name.strip())


def named(name: str) -> Column:
    """The column of exactly this name, dots and back-quotes included."""
    return F.col(f"`{name.replace('`', '``')}`")


def quoted_list(values: Column) -> Column:
    """``['a', 'b']`` from an array of strings."""
    return F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))


def fixed(value: Column, digits: int = 0) -> Column:
    """Text with so many decimals, rounded by the value the double really has.

    14.35 is stored a little below, so it is shown as 14.3; true halves go to the even digit.
    """
    scale = float(10**digits)
    size = F.abs(value.cast("double"))
    # two halves of the digits, each of which can be scaled without rounding
    wide = size * F.lit(134217729.0)
    head = wide - (wide - size)
    high, low = head * scale, (size - head) * scale
    whole = F.floor(high + low).cast("double")
    beyond_half = (high - (whole + 0.5)) + low
    up = (beyond_half > 0) | ((beyond_half == 0) & (whole % 2 == 1))
    rounded = (whole + up.cast("double")) / scale
    signed = F.when(value < 0, -rounded).otherwise(rounded)
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", signed))

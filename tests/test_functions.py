import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabulens.functions.dates import cadence, day_of_week, is_weekend, parse_date, pick_format, whole_days
from tabulens.functions.numbers import (
    null_non_finite,
    parse_number,
    plain_number,
    quartile_label,
    ratio,
    rounded,
    square_root,
)
from tabulens.functions.text import NA_TOKENS, fixed, is_blank, null_na_tokens, quoted_list, slug, tidy_name


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_parse_number(spark):
    cases = {
        "1,234": 1234.0, "5": 5.0, " 5 ": 5.0, "1e3": 1000.0, "-.5": -0.5, "1.": 1.0, "+7": 7.0,
        "1d": None, "1f": None, "x": None, "inf": None, "NaN": None, "": None, "1e999": None,
        "1 2": None, "--1": None, ",": None, "12,34,5": 12345.0,
    }
    assert column(spark, list(cases), "string", parse_number) == list(cases.values())


def test_null_non_finite(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert column(spark, values, "double", null_non_finite) == [1.0, None, None, None, None]


def test_plain_number(spark):
    values = [25.4022, 1e9, 12345678.1, 0.0, None, 100.0, -0.00012]
    shown = ["25.4022", "1000000000.0", "12345678.1", "0.0", "None", "100.0", "-0.0001"]
    assert column(spark, values, "double", plain_number) == shown


def test_rounding_and_roots(spark):
    assert column(spark, [1.23456, -0.00001, None], "double", rounded) == [1.2346, 0.0, None]
    assert column(spark, [4.0, -4.0, None], "double", square_root) == [2.0, 0.0, None]
    assert column(spark, [2.0, 0.0, None], "double", lambda v: ratio(F.lit(1.0), v)) == [0.5, None, None]


def test_quartile_labels_close_on_the_right(spark):
    labels = column(spark, [1.0, 2.0, 2.5, 3.0, 9.0, None], "double", lambda v: quartile_label(v, 2, 3, 4))
    assert labels == ["Q1", "Q1", "Q2", "Q2", "Q4", None]


@pytest.mark.parametrize(
    "text, fmt, year, month, day",
    [
        ("2024-01-05", "yyyy-M-d", 2024, 1, 5),
        ("2024-1-5", "yyyy-M-d", 2024, 1, 5),
        ("01/05/2024", "M/d/yyyy", 2024, 1, 5),
        ("13/05/2024", "d/M/yyyy", 2024, 5, 13),
        ("05 Jan 2024", "d MMM yyyy", 2024, 1, 5),
        ("Jan 05, 2024", "MMM d, yyyy", 2024, 1, 5),
    ],
)
def test_date_formats(spark, text, fmt, year, month, day):
    parsed = column(spark, [text, "x", None, "2024-13-45"], "string", lambda v: parse_date(v, fmt))
    assert parsed == [dt.datetime(year, month, day), None, None, None]


def test_first_value_fixes_the_format():
    assert pick_format([{"yyyy-M-d": True}, {"yyyy-M-d": True}]) == "yyyy-M-d"
    assert pick_format([{"yyyy-M-d": True}, {"M/d/yyyy": True}]) is None
    both = {"M/d/yyyy": True, "d/M/yyyy": True}
    assert pick_format([both, {"d/M/yyyy": True}]) is None
    assert pick_format([]) is None


def test_weekdays(spark):
    days = [dt.datetime(2024, 1, d) for d in (5, 6, 7, 8)] + [None]
    assert column(spark, days, "timestamp_ntz", day_of_week) == [4, 5, 6, 0, None]
    assert column(spark, days, "timestamp_ntz", is_weekend) == [0, 1, 1, 0, 0]


def test_whole_days_are_24_hours(spark):
    late = dt.datetime(2024, 1, 1, 23)
    ends = [dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 2, 23), dt.datetime(2024, 1, 4, 22)]
    assert column(spark, ends, "timestamp_ntz", lambda v: whole_days(F.lit(late), v)) == [0, 1, 2]


def test_cadence(spark):
    gaps = [0.0, 1.0, 1.5, 8.0, 9.0, 35.0, 36.0, 100.0, 101.0, None]
    names = ["daily", "daily", "weekly", "weekly", "monthly", "monthly", "quarterly", "quarterly",
             "yearly", None]
    assert column(spark, gaps, "double", cadence) == names


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_decimals_round_like_printf(spark, digits):
    rng = random.Random(digits)
    values = [0.0, 0.5, 1.5, 2.5, 14.35, 0.415, 0.125, 0.375, -0.4, -2.675, 2.675, 99.995, 60.25, 1e9 + 0.5]
    values += [round(rng.uniform(-100, 100), digits + 1) for _ in range(300)]
    shown = column(spark, values, "double", lambda v: fixed(v, digits))
    assert shown == [f"{v:.{digits}f}" for v in values]


def test_text_helpers(spark):
    assert column(spark, ["", "  ", "\t\n", "abc", " a "], "string", is_blank) == [
        True, True, True, False, False,
    ]
    assert column(spark, [*NA_TOKENS, "x", "na"], "string", null_na_tokens) == [
        *[None] * len(NA_TOKENS), "x", "na",
    ]
    assert column(spark, [["a", "b"]], "array<string>", quoted_list) == ["['a', 'b']"]
    assert slug("  Order Total ($) ") == "order_total"
    assert len(slug("x" * 50)) == 30
    assert tidy_name("  a \t  b ") == "a b"

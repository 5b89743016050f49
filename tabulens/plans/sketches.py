"""Profiles from mergeable sketches: one scan, and parts that add up without their data.

``sketch`` returns one row per column whose fields can be merged: counts, moments, ranks of the
numbers and of the text lengths, a HyperLogLog sketch of the values (distinct values), and the short
values with their counts as long as they are fewer than 1000. ``merge_sketches`` adds such rows up -
of days, folders, or tables that no longer exist - and ``sketched_profile`` estimates the profile
from them. A task sorts each piece of a column once, in Arrow batches (see summaries.py); only
distinct values and small rows leave it.

Exact are all counts, mean, deviation, skewness, kurtosis, extremes, lengths, and everything about
categories (a category has at most 100 values, far fewer than are listed). Estimated are quantiles
(rank error below RANK_ERROR), distinct values (relative error below DISTINCT_ERROR, in 99 of 100
columns), and what follows from them: outliers, entropy of numbers, discrete columns. Left NULL are
the mode and what needs the order of rows or of days: monotonic, gaps, regularity.

A text column counts as dates if all its values follow the format that its first values do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulens.batching import batches
from tabulens.functions.dates import whole_days
from tabulens.functions.numbers import is_number_text
from tabulens.functions.text import is_blank
from tabulens.operators.summaries import (
    BLANK,
    ITEMS,
    NUMERAL,
    SHORT,
    merged,
    quantiles,
    summaries,
)
from tabulens.plans.types import (
    CATEGORY_RATIO,
    CATEGORY_VALUES,
    NUMERIC_SHARE,
    ColumnType,
    _date_formats,
    _family,
)

DISTINCT_BITS = 14
RANK_ERROR, DISTINCT_ERROR = 0.005, 0.03
PROBABILITIES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
BINS = 20
GRID = 1000
# groups in which the first step of a merge adds up
PLACES = 64


def _cells(c: ColumnType) -> tuple[dict[str, Column], str | None]:
    """What the summaries read of a column, and which of it is the value."""
    family = _family(c.dtype)
    if family == "float":
        return {"number": c.number}, "number"
    if isinstance(c.dtype, T.DecimalType):
        return {"number": c.number, "word": c.text}, "word"
    if family == "number":
        return {"whole": c.column.cast("long")}, "whole"
    if family == "date":
        return {"stamp": c.timestamp.cast("timestamp_ntz")}, "stamp"
    if family == "nested":
        return {"present": c.column.isNotNull()}, None
    text = c.text
    length = F.length(text)
    numeral = is_number_text(c.column) if family == "string" else F.lit(True)
    # every cell costs as much as a value to send: what a text is goes in one
    bits = (length * 4).bitwiseOR(is_blank(text).cast("int") * BLANK)
    cells = {
        "number": c.number.cast("double"),
        "mark": bits.bitwiseOR(numeral.cast("int") * NUMERAL),
        "word": F.when(length > SHORT, F.hex(F.xxhash64(text))).otherwise(text),
    }
    if family == "string" and c.date_format:
        cells["stamp"] = c.timestamp.cast("timestamp_ntz")
    return cells, "word"


def _as_text(columns: Sequence[ColumnType]) -> Column:
    """The text of a value, from the column that its kind travels in."""
    days = [c.pos for c in columns if isinstance(c.dtype, T.DateType)]
    stamp = F.col("stamp").cast("string")
    if days:
        day = F.col("stamp").cast("date").cast("string")
        stamp = F.when(F.col("position").isin(days), day).otherwise(stamp)
    plain = [F.col("word"), F.col("whole").cast("string"), F.col("number").cast("string")]
    return F.coalesce(*plain, stamp)


def sketch(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """The mergeable row of every column: one scan, and the first values of text columns."""
    columns = [ColumnType(f.name, i, f.dataType) for i, f in enumerate(df.schema.fields)]
    texts = [c for c in columns if _family(c.dtype) == "string"]
    formats = _date_formats(df, texts, order_by)
    parts = []
    for batch in batches(columns):
        typed = [
            ColumnType(c.name, c.pos, c.dtype, date_format=formats.get(c.pos)) for c in batch
        ]
        cells = {c.pos: _cells(c) for c in typed}
        names = F.create_map(*[F.lit(x) for c in typed for x in (c.pos, c.name)])
        kinds = F.create_map(*[F.lit(x) for c in typed for x in (c.pos, _family(c.dtype))])
        written = F.create_map(*[F.lit(x) for c in typed for x in (c.pos, c.date_format or "")])
        found = summaries(
            df,
            {pos: own for pos, (own, _) in cells.items()},
            {pos: value for pos, (_, value) in cells.items() if value is not None},
            _as_text(typed),
            F.hll_sketch_agg("text", DISTINCT_BITS),
        )
        parts.append(
            found.select(
                names[F.col("position")].alias("column"),
                kinds[F.col("position")].alias("family"),
                written[F.col("position")].alias("written"),
                "*",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """The sketch of all rows from the sketches of parts of them, column by column of a name."""
    rows = reduce(DataFrame.unionByName, parts)
    place = F.pmod(F.xxhash64("distinct"), F.lit(PLACES))
    return merged(merged(rows, KEYS, *_alike(), place=place), KEYS, *_alike())


KEYS = "column string, family string, written string, position int"


def _alike() -> list[Column]:
    same = F.min("written") == F.max("written")
    family = F.when(F.min("family") == F.max("family"), F.min("family")).otherwise("string")
    return [
        family.alias("family"),
        F.when(same, F.min("written")).otherwise("").alias("written"),
        F.min("position").alias("position"),
    ]


def _share_upto(point: Column) -> Column:
    """Share of the numbers up to a point, from the quantiles of a fine grid."""
    return F.size(F.filter("grid", lambda v: v <= point)) / F.size("grid")


def _estimates(rows: DataFrame) -> DataFrame:
    """The sketches read out: distinct values, items by count, quantiles, the type."""
    counted = F.array_sort(
        "items",
        lambda a, b: F.when(a["count"] > b["count"], -1)
        .when(a["count"] < b["count"], 1)
        .when(a["item"] < b["item"], -1)
        .when(a["item"] > b["item"], 1)
        .otherwise(0),
    )
    # all values are listed with exact counts if the counts add up to the rows
    listed = F.aggregate("items", F.lit(0).cast("long"), lambda total, x: total + x["count"])
    complete = F.col("listed") & (listed == F.col("present"))
    family, present = F.col("family"), F.col("present")
    is_text = family.isin("string", "bool")
    number = (
        family.isin("float", "number")
        | ((family == "bool") & (present == F.col("total")))
        | ((family == "string") & (F.col("numbers") / present >= NUMERIC_SHARE))
    )
    date = (family == "date") | ((F.col("written") != "") & (F.col("dates") == present))
    few = (F.col("u") <= CATEGORY_VALUES) & (F.col("u") / present < CATEGORY_RATIO)
    kind = (
        F.when(family == "nested", "nested")
        .when(present == 0, "text")
        .when(number, "numeric")
        .when(date, "date")
        .when(is_text & few, "categorical")
        .otherwise("text")
    )
    fine = [(i + 0.5) / GRID for i in range(GRID)]
    # a sum of whole numbers has no error; a constant is its own mean
    mean = F.when(F.col("min") < F.col("max"), F.col("sum") / F.col("n")).otherwise(F.col("mean"))
    return (
        rows.withColumn("items", F.coalesce(counted, F.expr("array()").cast(ITEMS)))
        .withColumn(
            "u",
            F.when(complete, F.size("items").cast("long")).otherwise(
                F.hll_sketch_estimate("distinct")
            ),
        )
        .withColumn("type", kind)
        .withColumn(
            "measured",
            (F.col("type") == "numeric") & (family != "bool") & (F.col("n") >= 2),
        )
        .withColumn("mean", mean)
        .withColumn("q", F.when(F.col("measured"), quantiles("ranks", PROBABILITIES)))
        .withColumn("grid", F.when(F.col("measured"), quantiles("ranks", fine)))
    )


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """The profile that the sketches give, in the columns of an exact one."""
    from tabulens.plans.profile import RAW_SCHEMA, _profile_columns

    keys = ("column", "family", "written", "position", "distinct", "items")
    rows = _estimates(sketches.select(*keys, "state.*"))
    c = F.col
    n, spread = c("n"), c("m2") / c("n")
    low, high = c("q")[2], c("q")[4]
    fence = 1.5 * (high - low)
    varied = (c("max") > c("min")) & (spread > 0)
    std = F.when(varied, F.sqrt(c("m2") / (n - 1))).otherwise(0.0)
    iqr = [_share_upto(low - fence), _share_upto(high + fence)]
    z = [_share_upto(c("mean") - 3 * std), _share_upto(c("mean") + 3 * std)]
    # bins of a constant column: all values in one
    width = (c("max") - c("min")) / F.least(n, F.lit(BINS))
    edges = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(BINS)).cast("int")),
        lambda i: F.when(i == F.least(n, F.lit(BINS)), c("max")).otherwise(c("min") + width * i),
    )
    upto = F.transform(edges, _share_upto)
    shares = F.transform(
        F.sequence(F.lit(1), F.size(upto)),
        lambda i: F.element_at(upto, i) - F.when(i > 1, F.get(upto, i - 2)).otherwise(0.0),
    )
    entropy = F.aggregate(
        F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p)
    )

    def counted(share: list[Column]) -> Column:
        return F.round(n * (share[0] + 1 - share[1])).cast("long")

    measured, category = c("measured"), c("type") == "categorical"
    date, text = c("type") == "date", (c("type") == "text") & (c("present") > 0)
    p = F.transform("items", lambda x: x["count"] / c("present"))
    entropy_of = F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log2(x + 1e-12))
    tops = F.slice("items", 1, 10)
    values = {
        "column": c("column"), "position": c("position"), "type": c("type"),
        "total": c("total"), "missing": c("total") - c("present"),
        "mean": F.when(measured, c("mean")),
        "std": F.when(measured, std),
        "min": F.when(measured, c("min")), "max": F.when(measured, c("max")),
        **{
            name: F.when(measured, c("q")[i])
            for i, name in enumerate(("p05", "p10", "q1", "median", "q3", "p90", "p95"))
        },
        "skewness": F.when(measured & varied, c("m3") / n / F.pow(spread, F.lit(1.5))),
        "kurtosis": F.when(measured & varied, c("m4") / n / (spread * spread) - 3),
        "outliers_iqr": F.when(measured, counted(iqr)),
        "outliers_z": F.when(measured, F.when(std > 0, counted(z)).otherwise(0)),
        "numeric_entropy": F.when(measured, F.when(width > 0, entropy).otherwise(0.0)),
        "zero_count": F.when(measured, c("zeros")),
        "negative_count": F.when(measured, c("negatives")),
        "n_valid": F.when(measured, n).when(category | text, c("present")).when(date, c("dates")),
        "n_unique_vals": F.when(measured, F.least(c("u"), n)),
        "all_integers": F.when(measured, c("integers") == n),
        "unique_count": F.when(category | text, F.least(c("u"), c("present"))),
        "cardinality_ratio": F.when(category, c("u") / c("present")),
        "dominant_value": F.when(category, tops[0]["item"]),
        "dominant_rate": F.when(category, tops[0]["count"] / c("present") * 100),
        "categorical_entropy": F.when(category, entropy_of),
        "normalised_entropy": F.when(
            category, entropy_of / F.when(c("u") > 1, F.log2(c("u"))).otherwise(1.0)
        ),
        "balance_score": F.when(category, 1 - tops[0]["count"] / c("present")),
        "gini_impurity": F.when(category, 1 - F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x)),
        "top_values": F.when(category, tops["item"]),
        "top_counts": F.when(category, tops["count"]),
        "top_pcts": F.when(
            category,
            F.transform(tops, lambda x: F.round(x["count"] / c("present") * 100, 2)),
        ),
        "first": F.when(date, c("first")), "last": F.when(date, c("last")),
        "range_days": F.when(date, whole_days(c("first"), c("last"))),
        "unique_dates": F.when(date, F.least(c("u"), c("dates"))),
        "avg_length": F.when(text, c("characters") / c("present")),
        "median_length": F.when(
            text,
            quantiles("lengths", (0.5,))[0],
        ),
        "max_length": F.when(text, c("longest")), "min_length": F.when(text, c("shortest")),
        "blank_count": F.when(text, c("blanks")),
    }
    raw = []
    for field in RAW_SCHEMA.split(", "):
        name, kind = field.split()
        raw.append(values.get(name, F.lit(None)).cast(kind).alias(name))
    return rows.select(*raw).select(*_profile_columns()).orderBy("position")

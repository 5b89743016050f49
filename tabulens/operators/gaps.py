"""Steps between consecutive dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulens.functions.dates import whole_days
from tabulens.operators.frequency import value_counts


def date_gaps(long: DataFrame) -> DataFrame:
    """(pos, gap, n): how often each gap in whole days occurs in sorted order.

    Timestamps of one calendar day are less than 24 hours apart, so all gaps inside a day
    are 0 and only the first and last timestamp of a day matter. Equal timestamps are counted
    first, and then reduced to one row per day before anything is ordered: a column has at
    most as many as the calendar has days, whatever the number of rows. The rows of a day,
    its distinct timestamps and its ends are summed up along the gaps.
    """
    days = (
        value_counts(long, "pos", "value")
        .groupBy("pos", F.to_date("value").alias("day"))
        .agg(
            F.min("value").alias("first"),
            F.max("value").alias("last"),
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("distinct"),
        )
    )
    order = Window.partitionBy("pos").orderBy("day")
    none = F.lit(0).cast("long")
    within = F.struct(
        none.alias("gap"), (F.col("n") - 1).alias("n"), F.col("n").alias("rows"),
        "distinct", "first", "last",
    )
    across = F.struct(
        whole_days(F.lag("last").over(order), F.col("first")).alias("gap"),
        F.lit(1).cast("long").alias("n"), none.alias("rows"), none.alias("distinct"),
        F.lit(None).cast("timestamp_ntz").alias("first"),
        F.lit(None).cast("timestamp_ntz").alias("last"),
    )
    return (
        days.select("pos", within.alias("within"), across.alias("across"))
        .select("pos", F.inline(F.array("within", "across")))
        .where(F.col("gap").isNotNull())
        .groupBy("pos", "gap")
        .agg(
            F.sum("n").alias("n"),
            F.sum("rows").alias("rows"),
            F.sum("distinct").alias("distinct"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
    )


def date_summary(long: DataFrame) -> DataFrame:
    """Rows, distinct dates, span, median gap and the share of gaps near it, per position.

    Distinct gaps are few (whole days between calendar days), so they are kept as a list.
    """
    some = F.col("n") > 0
    summary = date_gaps(long).groupBy("pos").agg(
        F.sum("rows").alias("n_valid"),
        F.sum("distinct").alias("unique_dates"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.percentile(F.when(some, F.col("gap")), 0.5, F.col("n")).alias("median_gap_days"),
        F.collect_list(F.when(some, F.struct("gap", "n"))).alias("gaps"),
        F.sum("n").alias("total"),
    )
    median = F.col("median_gap_days")

    def near(step: Column) -> Column:
        return F.abs(step["gap"] - median) / median < 0.5

    regular = F.aggregate(
        F.filter("gaps", near), F.lit(0).cast("long"), lambda total, step: total + step["n"]
    )
    # a median of 0 has no regularity
    return summary.select(
        "pos",
        "n_valid",
        "unique_dates",
        "first",
        "last",
        whole_days(F.col("first"), F.col("last")).alias("range_days"),
        "median_gap_days",
        F.when(median > 0, regular / F.col("total") * 100).alias("regularity_pct"),
    )


def gap_metrics(long: DataFrame) -> DataFrame:
    """Median gap and regularity of the positions that have a gap."""
    gaps = date_summary(long).where(F.col("median_gap_days").isNotNull())
    return gaps.select("pos", "median_gap_days", "regularity_pct")


def date_spans(long: DataFrame) -> DataFrame:
    """First and last date, span in whole days and number of rows per position."""
    return long.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.min("value").alias("first"),
        F.max("value").alias("last"),
    ).withColumn("range_days", whole_days(F.col("first"), F.col("last")))

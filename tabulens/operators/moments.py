"""Single-pass summaries of many columns at once.

The input is the long form (pos, value), so the plan has the same size for 3 and for 300
columns, and every task sends one small row per column to the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def moments(long: DataFrame) -> DataFrame:
    """Count, extremes, mean, spread, shape and flags per position."""
    value = F.col("value")
    return long.groupBy("pos").agg(
        F.count("value").alias("n_valid"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
        F.count_if(value == 0).alias("zero_count"),
        F.count_if(value < 0).alias("negative_count"),
        F.bool_and(value == F.floor(value)).alias("all_integers"),
    )


def text_lengths(long: DataFrame) -> DataFrame:
    """Length statistics and blanks per position, from rows (pos, value, blank).

    Rows are first counted per length; the median then works on that short list.
    """
    per_length = long.groupBy("pos", F.col("value").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("blank").alias("blanks")
    )
    return per_length.groupBy("pos").agg(
        F.sum("n").alias("n_valid"),
        (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("avg_length"),
        F.percentile("length", 0.5, F.col("n")).alias("median_length"),
        F.max("length").alias("max_length"),
        F.min("length").alias("min_length"),
        F.sum("blanks").alias("blank_count"),
    )

"""Queries of mergeable sketches, held against exact SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulens.operators.frequency import to_long
from tabulens.plans.sketches import (
    DISTINCT_ERROR,
    RANK_ERROR,
    merge_sketches,
    sketch,
    sketched_profile,
)
from verification.datasets import table
from verification.registry import query

PARTS = 3
NUMBERS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
)
QUANTILES = {"p05": 0.05, "p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95}


def _merged(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The profile of a table from the sketches of its parts, which are written and read back."""
    from verification.plan_queries import _scratch

    path = _scratch(spark, f"sketches-{name}")
    df = table(spark, sf_dir, name)
    for part in range(PARTS):
        sketch(df.where(F.col(key) % PARTS == part)).write.parquet(f"{path}/part={part}")
    parts = [spark.read.parquet(f"{path}/part={part}") for part in range(PARTS)]
    return sketched_profile(merge_sketches(*parts))


def _each(columns, sql: str) -> str:
    return " UNION ALL ".join(sql.replace("{c}", c) for c in columns)


@query(
    "sketch_merged_numbers",
    _each(
        NUMBERS,
        "SELECT '{c}' AS \"column\", count({c}) AS n, CAST(min({c}) AS DOUBLE) AS low,"
        " CAST(max({c}) AS DOUBLE) AS high, round(avg({c}), 2) AS mean,"
        " round(stddev_samp({c}), 2) AS std, count(*) FILTER ({c} = 0) AS zeros,"
        " round(skewness_pop({c}), 2) + 0.0 AS skew FROM (SELECT * FROM lineitem)".replace(
            "round(skewness_pop({c}), 2) + 0.0",
            "round((sum(pow({c} - m, 3)) / count(*)) / pow(sum(pow({c} - m, 2)) / count(*), 1.5), 2)"
            " + 0.0",
        ).replace("(SELECT * FROM lineitem)", "lineitem, (SELECT avg({c}) AS m FROM lineitem) a"),
    ),
)
def sketch_merged_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of all number columns from merged parts."""
    prof = _merged(spark, sf_dir, "lineitem", "l_orderkey").where(F.col("column").isin(NUMBERS))
    return prof.select(
        "column",
        F.col("n_valid").alias("n"),
        F.col("min").alias("low"),
        F.col("max").alias("high"),
        F.round("mean", 2).alias("mean"),
        F.round("std", 2).alias("std"),
        F.col("zero_count").alias("zeros"),
        (F.round("skewness", 2) + 0.0).alias("skew"),
    )


@query(
    "sketch_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{name}' AS metric, count({c}) AS n, true AS within FROM lineitem"
        for c in NUMBERS
        for name in QUANTILES
    ),
)
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every quantile from merged parts is within the rank error of the exact one.

    The exact share of rows below and up to each estimate is counted in the whole table.
    """
    prof = _merged(spark, sf_dir, "lineitem", "l_orderkey").where(F.col("column").isin(NUMBERS))
    pairs = [F.struct(F.lit(n).alias("metric"), F.lit(p).alias("p"), F.col(n).alias("v")) for n, p in QUANTILES.items()]
    wanted = prof.select("position", "column", F.explode(F.array(*pairs)).alias("w"))
    df = table(spark, sf_dir, "lineitem")
    values = {i: F.col(n).cast("double") for i, n in enumerate(df.columns) if n in NUMBERS}
    counted = (
        to_long(df, values)
        .join(F.broadcast(wanted.withColumnRenamed("position", "pos")), "pos")
        .groupBy("column", "w.metric", "w.p")
        .agg(
            F.count("value").alias("n"),
            # estimates are rounded to four places in a profile
            F.count_if(F.col("value") < F.col("w.v") - 5e-5).alias("below"),
            F.count_if(F.col("value") <= F.col("w.v") + 5e-5).alias("upto"),
        )
    )
    p, n = F.col("p"), F.col("n")
    within = (F.col("below") / n - RANK_ERROR <= p) & (F.col("upto") / n + RANK_ERROR >= p)
    return counted.select("column", "metric", "n", within.alias("within"))


DISTINCT = {
    "lineitem": (
        "l_orderkey",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"],
    ),
    "documents": ("doc_id", ["doc_id", "text", "n_chars"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_acctbal"]),
}


@query(
    "sketch_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, true AS within FROM {name}"
        for name, (_, columns) in DISTINCT.items()
        for c in columns
    ),
)
def sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether distinct counts from merged parts are within the error of the exact ones."""
    out = None
    for name, (key, columns) in DISTINCT.items():
        prof = _merged(spark, sf_dir, name, key).where(F.col("column").isin(columns))
        exact = table(spark, sf_dir, name).agg(*[F.count_distinct(c).alias(c) for c in columns])
        exact = exact.unpivot([], columns, "column", "exact")
        estimate = F.coalesce("n_unique_vals", "unique_count")
        error = F.abs(estimate - F.col("exact")) / F.col("exact")
        rows = prof.join(F.broadcast(exact), "column").select(
            "column", (F.col("total") - F.col("missing")).alias("n"),
            (error <= DISTINCT_ERROR).alias("within"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


CATEGORIES = ("l_returnflag", "l_linestatus")


@query(
    "sketch_categories",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS \"value\", count(*) AS n,"
        f" round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS pct"
        f" FROM lineitem GROUP BY {c}"
        for c in CATEGORIES
    ),
)
def sketch_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of categories from merged parts, which are exact."""
    prof = _merged(spark, sf_dir, "lineitem", "l_orderkey").where("type = 'categorical'")
    tops = F.arrays_zip("top_values", "top_counts", "top_pcts")
    return prof.select("column", F.explode(tops).alias("t")).select(
        "column", F.col("t.top_values").alias("value"), F.col("t.top_counts").alias("n"),
        F.col("t.top_pcts").alias("pct"),
    )

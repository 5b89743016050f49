"""Queries about whole analyses: importance, choices, findings, features, report, files."""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulens.functions.numbers import parse_number
from tabulens.plans import charts
from tabulens.plans.choose import choose_charts, choose_pair_charts
from tabulens.plans.features import add_features, feature_catalogue, suggest_features
from tabulens.plans.importance import score_columns
from tabulens.plans.insights import find_insights
from tabulens.plans.profile import column_metrics, profile, profile_frame
from tabulens.plans.report import digest, preview
from tabulens.plans.types import detect_types
from tabulens.session import ensure_checkpoint_dir
from tabulens.sources import clean_table, read_csv, read_json, read_table
from verification.datasets import EVENTS, LABELLED, MIXED, ORDERS, Dataset, load, table
from verification.plan_sql import (
    chart_choice_sql,
    digest_sql,
    feature_catalogue_sql,
    importance_sql,
    insights_sql,
    pair_choice_sql,
)
from verification.registry import query


def _register() -> None:
    for dataset in (ORDERS, LABELLED, MIXED):

        def importance(spark: SparkSession, sf_dir: str, d: Dataset = dataset) -> DataFrame:
            scores = score_columns(profile(load(spark, sf_dir, d), d.order))
            reasons = F.array_join("reasons", " | ").alias("reasons")
            return scores.select("column", "type", "score", "label", "missing_rate", reasons)

        query(f"importance_{dataset.name}", importance_sql(dataset))(importance)
    for dataset in (EVENTS, MIXED):

        def insights(spark: SparkSession, sf_dir: str, d: Dataset = dataset) -> DataFrame:
            df = load(spark, sf_dir, d)
            types = detect_types(df, d.order)
            prof = profile_frame(spark, column_metrics(df, d.order, types))
            found = find_insights(prof, score_columns(prof), charts.correlations(df, types))
            return found.withColumn("cols", F.array_join("cols", ","))

        def pair_choice(spark: SparkSession, sf_dir: str, d: Dataset = dataset) -> DataFrame:
            df = load(spark, sf_dir, d)
            types = detect_types(df, d.order)
            prof = profile_frame(spark, column_metrics(df, d.order, types))
            chosen = choose_pair_charts(prof, charts.correlations(df, types))
            return chosen.select("col_x", "col_y", F.col("keep").cast("int").alias("keep"), "chart")

        query(f"insights_{dataset.name}", insights_sql(dataset))(insights)
        query(f"pair_choice_{dataset.name}", pair_choice_sql(dataset))(pair_choice)


_register()


@query("chart_choice", chart_choice_sql(MIXED))
def chart_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = profile(load(spark, sf_dir, MIXED), MIXED.order)
    return choose_charts(prof).select("column", "type", "chart")


OTHERS = {
    "histogram": "boxplot", "boxplot": "violin,histogram", "lollipop": "bar", "bar": "lollipop,treemap",
    "pie": "donut,bar", "donut": "pie,bar", "treemap": "bar,lollipop", "line": "area,scatter",
}


@query(
    "chart_alternatives",
    'SELECT "column", chart, CASE chart '
    + " ".join(f"WHEN '{chart}' THEN '{others}'" for chart, others in OTHERS.items())
    + f" ELSE '' END AS alternatives FROM ({chart_choice_sql(LABELLED)})",
)
def chart_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = choose_charts(profile(load(spark, sf_dir, LABELLED), LABELLED.order))
    return chosen.select("column", "chart", F.array_join("alternatives", ",").alias("alternatives"))


@query("digest", digest_sql(ORDERS, "orders"))
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = profile(load(spark, sf_dir, ORDERS), ORDERS.order)
    return digest(prof, score_columns(prof), "orders")


@query(
    "preview",
    "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 10",
)
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return preview(df, ["event_id"])


# features -----------------------------------------------------------------------------


@query("feature_catalogue", feature_catalogue_sql(EVENTS))
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, EVENTS)
    types = detect_types(df, EVENTS.order)
    features = suggest_features(types, column_metrics(df, EVENTS.order, types))
    return feature_catalogue(spark, features).select(
        "seq", "name", "transform", F.element_at("source_cols", 1).alias("source"), "reason"
    )


def _with_features(spark: SparkSession, sf_dir: str, dataset: Dataset, *keep: str) -> DataFrame:
    df = load(spark, sf_dir, dataset).select(*keep)
    types = detect_types(df, dataset.order)
    features = suggest_features(types, column_metrics(df, dataset.order, types))
    return add_features(df, features)


@query(
    "feat_numeric",
    "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d, quantile_cont(value, 0.25) AS q1,"
    " quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events)"
    " SELECT event_id, round(ln(1 + value), 6) AS log1p_value,"
    " round((value - m) / d, 6) + 0.0 AS zscore_value, CASE WHEN value <= q1 THEN 'Q1'"
    " WHEN value <= q2 THEN 'Q2' WHEN value <= q3 THEN 'Q3' ELSE 'Q4' END AS bin_value"
    " FROM events, s",
)
def feat_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _with_features(spark, sf_dir, EVENTS, "event_id", "value")
    return out.select("event_id", "log1p_value", "zscore_value", "bin_value")


@query(
    "feat_sqrt",
    "WITH v AS (SELECT event_id, CAST(sqrt(value) * 10 AS DOUBLE) AS root FROM events)"
    " SELECT event_id, round(sqrt(root), 6) AS sqrt_root FROM v",
)
def feat_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The square root of a value with a long tail has a moderate one."""
    df = table(spark, sf_dir, "events").selectExpr("event_id", "sqrt(value) * 10 AS root")
    types = detect_types(df, ["event_id"])
    features = suggest_features(types, column_metrics(df, ["event_id"], types))
    return add_features(df, features).select("event_id", "sqrt_root")


@query(
    "feat_date",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year,"
    " CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate_month,"
    " CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_dayofweek,"
    " CAST(quarter(o_orderdate) AS DOUBLE) AS o_orderdate_quarter,"
    " CASE WHEN isodow(o_orderdate) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    " AS o_orderdate_is_weekend FROM orders",
)
def feat_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _with_features(spark, sf_dir, ORDERS, "o_orderkey", "o_orderdate")
    parts = ("year", "month", "dayofweek", "quarter", "is_weekend")
    return out.select("o_orderkey", *[f"o_orderdate_{part}" for part in parts])


@query(
    "feat_freq",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS freq_o_orderpriority,"
    " count(*) OVER (PARTITION BY o_orderstatus) AS freq_o_orderstatus FROM orders",
)
def feat_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = _with_features(spark, sf_dir, ORDERS, *names)
    return out.select("o_orderkey", "freq_o_orderpriority", "freq_o_orderstatus")


RATIOS = {
    "ratio_order_sales_per_unit_cost": ("l_extendedprice", "l_discount"),
    "ratio_net_profit_per_unit_cost": ("l_tax", "l_discount"),
    "ratio_order_sales_per_page_visits": ("l_extendedprice", "l_quantity"),
    "ratio_net_profit_per_order_sales": ("l_tax", "l_extendedprice"),
}


@query(
    "feat_ratio",
    "SELECT l_returnflag AS flag, "
    + ", ".join(
        f"count({n} / nullif({d}, 0)) AS n_{i}, round(sum(round({n} / nullif({d}, 0), 6)), 2) AS sum_{i}"
        for i, (n, d) in enumerate(RATIOS.values())
    )
    + " FROM lineitem GROUP BY l_returnflag",
)
def feat_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_extendedprice").alias("Order Sales"),
        F.col("l_discount").alias("unit_cost"),
        F.col("l_quantity").alias("page_visits"),
        F.col("l_tax").alias("net_profit"),
    )
    types = detect_types(df)
    features = suggest_features(types, column_metrics(df, (), types))
    ratios = [f for f in features if f.transform == "ratio"]
    sums = []
    for i, name in enumerate(RATIOS):
        sums += [F.count(name).alias(f"n_{i}"), F.round(F.sum(name), 2).alias(f"sum_{i}")]
    return add_features(df, ratios).groupBy("flag").agg(*sums)


# files --------------------------------------------------------------------------------


@query(
    "clean_table",
    'SELECT o_orderkey + 1 AS "order key", o_totalprice AS price,'
    " CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders",
)
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untidy names, an empty column and two row-number columns."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS `Unnamed: 0`",
        "o_orderkey AS `index`",
        "o_orderkey + 1 AS `  order \t key `",
        "o_totalprice AS price",
        "CAST(NULL AS STRING) AS nothing",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS ` status`",
    )
    return clean_table(df, ["index"])


@query(
    "drop_empty_rows",
    "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 10 <> 3",
)
def drop_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.col("o_orderkey") % 10 != 3
    df = table(spark, sf_dir, "orders").select(
        F.when(keep, F.col("o_totalprice")).alias("price"),
        F.when(keep, F.col("o_orderstatus")).alias("status"),
    )
    return clean_table(df).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total")
    )


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


CUSTOMERS = (
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment"
    " FROM customer"
)


def _typed(df: DataFrame) -> DataFrame:
    """The customers as read, whatever types their source has."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}

    def number(name: str) -> Column:
        return parse_number(F.col(name)) if name in text else F.col(name)

    return df.select(
        number("c_custkey").cast("long").alias("c_custkey"),
        "c_name",
        number("c_nationkey").cast("long").alias("c_nationkey"),
        number("c_acctbal").cast("double").alias("c_acctbal"),
        "c_mktsegment",
    )


@query("csv_roundtrip", CUSTOMERS)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited file written and read back; the delimiter is found out."""
    path = _scratch(spark, "customer-csv")
    table(spark, sf_dir, "customer").write.option("header", True).option("sep", ";").csv(path)
    return _typed(read_csv(spark, path))


@query("read_table", CUSTOMERS)
def read_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of a file is told by its extension."""
    path = f"{_scratch(spark, 'customer')}.csv"
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return _typed(read_table(spark, path))


@query(
    "csv_quoted_breaks",
    CUSTOMERS.replace("c_name,", "c_name || chr(10) || c_mktsegment AS c_name,"),
)
def csv_quoted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks inside quotes belong to the value."""
    path = _scratch(spark, "customer-breaks")
    name = F.concat("c_name", F.lit("\n"), "c_mktsegment")
    table(spark, sf_dir, "customer").withColumn("c_name", name).write.option("header", True).csv(path)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _typed(read_csv(spark, path))


@query("json_roundtrip", CUSTOMERS)
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "customer-json")
    table(spark, sf_dir, "customer").write.json(path)
    return _typed(read_json(spark, path))


@query("json_lines_blank_head", CUSTOMERS)
def json_lines_blank_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines, also the first of a file, are no records."""
    path = _scratch(spark, "customer-blank")
    record = F.concat(F.lit("\n"), F.to_json(F.struct("*")))
    table(spark, sf_dir, "customer").select(record).write.text(path)
    return _typed(read_json(spark, path))


# ranges of keys that are written to files of their own
FILES = 8


def _read_files(spark: SparkSession, name: str, texts: DataFrame) -> DataFrame:
    """Customers written as JSON, a file for each row of ``texts``, and read back from the folder."""
    path = _scratch(spark, name)
    folders = texts.withColumn("part", F.xxhash64("value"))
    folders.write.partitionBy("part").text(path)
    return _typed(read_json(spark, f"{path}/*"))


def _ranges(spark: SparkSession, sf_dir: str, document: Column) -> DataFrame:
    """``document`` of each range of the customers."""
    customers = table(spark, sf_dir, "customer")
    part = F.col("c_custkey") % FILES
    return customers.groupBy(part.alias("part")).agg(document.alias("value")).select("value")


def _records() -> Column:
    return F.array_join(F.collect_list(F.to_json(F.struct("*"))), ",\n")


@query("json_array", CUSTOMERS)
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of arrays, a record on each line."""
    document = F.concat(F.lit("[\n"), _records(), F.lit("\n]"))
    return _read_files(spark, "customer-array", _ranges(spark, sf_dir, document))


@query("json_wrapper", CUSTOMERS)
def json_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one object each, whose records stand under a wrapping key."""
    document = F.concat(F.lit('{"source": "shop", "records": ['), _records(), F.lit("]}"))
    return _read_files(spark, "customer-wrapper", _ranges(spark, sf_dir, document))


@query("json_columns", CUSTOMERS)
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one object of columns each."""
    names = table(spark, sf_dir, "customer").columns
    document = F.to_json(F.struct(*(F.collect_list(n).alias(n) for n in names)))
    return _read_files(spark, "customer-columns", _ranges(spark, sf_dir, document))


@query("json_arrays", CUSTOMERS)
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array on each line."""
    customers = table(spark, sf_dir, "customer")
    block = F.floor(F.col("c_custkey") / 50)
    arrays = customers.groupBy(block.alias("block")).agg(
        F.to_json(F.collect_list(F.struct(*customers.columns))).alias("value")
    )
    path = _scratch(spark, "customer-arrays")
    arrays.select("value").write.text(path)
    return _typed(read_json(spark, path))


@query("json_concatenated", CUSTOMERS)
def json_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records one after another: some over many lines, some several on a line."""
    record = F.to_json(F.struct("*"), {"pretty": "true"})
    short = F.to_json(F.struct("*"))
    odd = F.col("c_custkey") % 2 == 1
    text = F.array_join(F.collect_list(F.when(odd, record).otherwise(short)), " ")
    return _read_files(spark, "customer-concatenated", _ranges(spark, sf_dir, text))


@query("json_utf16", CUSTOMERS)
def json_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record on each line, in UTF-16."""
    path = _scratch(spark, "customer-utf16")
    wide = {"encoding": "UTF-16LE", "lineSep": "\n"}
    table(spark, sf_dir, "customer").write.options(**wide).json(path)
    return _typed(read_json(spark, path, encoding="utf-16-le"))


@query(
    "report_written",
    "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY o_orderpriority",
)
def report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written with its chart data, and one chart read back."""
    from tabulens.plans.report import full_report
    from tabulens.sources import write_report

    path = _scratch(spark, "report")
    write_report(full_report(load(spark, sf_dir, ORDERS), ORDERS.order), path)
    return spark.read.json(f"{path}/chart_data/bar_o_orderpriority").select("label", "n")


@query(
    "na_tokens",
    "SELECT o_orderstatus AS status, count(CASE WHEN o_custkey % 4 <> 0 THEN 1 END) AS present,"
    " count(CASE WHEN o_custkey % 4 = 0 THEN 1 END) AS missing FROM orders GROUP BY o_orderstatus",
)
def na_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several ways to write a missing value, read back from a file."""
    words = F.array(*[F.lit(w) for w in ("NA", "n/a", "null", "#N/A", "-nan")])
    word = F.element_at(words, (F.col("o_orderkey") % 5 + 1).cast("int"))
    value = F.when(F.col("o_custkey") % 4 == 0, word).otherwise(F.col("o_custkey").cast("string"))
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status"), value.alias("customer")
    )
    path = _scratch(spark, "orders-csv")
    df.write.option("header", True).csv(path)
    return (
        read_csv(spark, path)
        .groupBy("status")
        .agg(
            F.count("customer").alias("present"),
            F.count_if(F.col("customer").isNull()).alias("missing"),
        )
    )


@query(
    "report_counts",
    "SELECT 'rows' AS item, count(*) AS n FROM orders UNION ALL"
    " SELECT 'columns', 6 UNION ALL SELECT 'preview', least(10, count(*)) FROM orders",
)
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a report's parts."""
    from tabulens.plans.report import full_report

    report = full_report(load(spark, sf_dir, ORDERS), ORDERS.order)
    parts = [
        report.quality.select(F.lit("rows").alias("item"), F.col("rows").alias("n")),
        report.quality.select(F.lit("columns").alias("item"), F.col("columns").alias("n")),
        report.preview.agg(F.count(F.lit(1)).alias("n")).select(F.lit("preview").alias("item"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)

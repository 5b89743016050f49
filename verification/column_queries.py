"""Queries about single columns: types, profiles, histograms, value counts, row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulens.functions.dates import parse_date
from tabulens.functions.numbers import parse_number, rounded
from tabulens.operators.bins import spread_metrics
from tabulens.operators.frequency import distinct_counts, ranked, to_long, value_counts
from tabulens.operators.moments import moments
from tabulens.operators.ordinal import every_nth, monotonic_flags, with_ordinal
from tabulens.operators.quantiles import exact_quantiles
from tabulens.plans import charts
from tabulens.plans.profile import (
    PROBABILITIES,
    QUANTILE_NAMES,
    categorical_metrics,
    column_metrics,
    date_metrics,
    numeric_metrics,
    profile,
    profile_frame,
    quality_summary,
    text_metrics,
)
from tabulens.plans.types import ColumnType, detect_types, types_frame
from tabulens.session import small_table
from verification.datasets import (
    C,
    CONVERSATIONS,
    CUSTOMER,
    EVENTS,
    LABELLED,
    LINEITEM,
    N,
    ORDERS,
    PART,
    Dataset,
    load,
    table,
)
from verification.profile_sql import BOOLEANS, LABELS, METRICS, labels_sql, metrics_sql, profile_sql
from verification.registry import query

CONTINUOUS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def typed(df: DataFrame, dataset: Dataset, columns: Sequence[str] | None = None) -> list[ColumnType]:
    """Column types of a known table, without the detection passes."""
    total = df.count()
    present = df.agg(*[F.count(f"`{n}`").alias(n) for n in dataset.columns]).first()
    return [
        ColumnType(
            name, i, df.schema[name].dataType, dataset.columns[name], None, total, present[name]
        )
        for i, name in enumerate(dataset.columns)
        if columns is None or name in columns
    ]


def one(df: DataFrame, dataset: Dataset, column: str) -> ColumnType:
    return typed(df, dataset, [column])[0]


def metric_rows(prof: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(column, metric, value) of the non-null metrics."""
    values = [F.col(m).cast("int").cast("double") if m in BOOLEANS else F.col(m).cast("double") for m in metrics]
    wide = prof.select("column", *[v.alias(m) for v, m in zip(values, metrics)])
    return wide.unpivot(["column"], list(metrics), "metric", "value").where("value IS NOT NULL")


def label_rows(prof: DataFrame) -> DataFrame:
    """(column, metric, value) of the non-null classifications."""
    texts = [
        F.array_join(m, "|").alias(m) if m == "top_values" else F.col(m).alias(m) for m in LABELS
    ]
    wide = prof.select("column", *texts)
    return wide.unpivot(["column"], LABELS, "metric", "value").where("value IS NOT NULL")


def _partial(
    df: DataFrame, types: Sequence[ColumnType], found: dict[int, dict]
) -> DataFrame:
    """Profile rows of some columns from already computed metrics."""
    rows = [
        {
            "column": c.name, "position": c.pos, "type": c.kind, "total": c.total,
            "missing": c.total - c.present, **found.get(c.pos, {}),
        }
        for c in types
    ]
    return profile_frame(df.sparkSession, rows)


# whole profiles -----------------------------------------------------------------------


def _register_profiles() -> None:
    for dataset in (ORDERS, EVENTS, CUSTOMER, LABELLED, LINEITEM):

        def run(spark: SparkSession, sf_dir: str, dataset: Dataset = dataset) -> DataFrame:
            return metric_rows(profile(load(spark, sf_dir, dataset), dataset.order), METRICS)

        query(f"profile_{dataset.name}", metrics_sql(dataset, METRICS))(run)
    for dataset in (ORDERS, LABELLED):

        def labels(spark: SparkSession, sf_dir: str, dataset: Dataset = dataset) -> DataFrame:
            return label_rows(profile(load(spark, sf_dir, dataset), dataset.order))

        query(f"profile_labels_{dataset.name}", labels_sql(dataset))(labels)


_register_profiles()


# numeric columns ----------------------------------------------------------------------

SUMMARY = ["mean", "median", "mode", "std", "variance", "cv_pct", "min", "max", "range", "q1",
           "q3", "iqr", "p05", "p10", "p90", "p95", "variance_score"]


@query("numeric_profile", metrics_sql(LINEITEM, SUMMARY, CONTINUOUS))
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, LINEITEM)
    types = typed(df, LINEITEM, CONTINUOUS)
    return metric_rows(_partial(df, types, numeric_metrics(df, types)), SUMMARY)


@query(
    "moment_summary",
    "SELECT pos, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,"
    " min(v) AS min, max(v) AS max, CAST(count_if(v = 0) AS BIGINT) AS zero_count FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS pos, CAST({c} AS DOUBLE) AS v FROM lineitem"
        for i, c in enumerate(LINEITEM.of(N))
    )
    + ") GROUP BY pos",
)
def moment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, LINEITEM)
    numbers = {i: F.col(c).cast("double") for i, c in enumerate(LINEITEM.of(N))}
    return moments(to_long(df, numbers)).select(
        "pos", F.col("n_valid").alias("n"), rounded(F.col("mean")).alias("mean"),
        rounded(F.col("std")).alias("std"), "min", "max", "zero_count",
    )


@query("shape_profile", metrics_sql(EVENTS, ["skewness", "kurtosis", "is_normal_like"], ["value", "user_id"]))
def shape_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, EVENTS)
    types = typed(df, EVENTS, ["value", "user_id"])
    found = moments(to_long(df, {c.pos: c.number for c in types})).collect()
    prof = _partial(df, types, {r["pos"]: r.asDict() for r in found})
    return metric_rows(prof, ["skewness", "kurtosis", "is_normal_like"])


OUTLIERS = ["outliers_iqr", "outliers_z", "outlier_ratio", "numeric_entropy"]


@query("outlier_profile", metrics_sql(EVENTS, OUTLIERS, ["event_id", "user_id", "value"]))
def outlier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlier counts and binned entropy in one pass after moments and quartiles."""
    df = load(spark, sf_dir, EVENTS)
    types = typed(df, EVENTS, ["event_id", "user_id", "value"])
    long = to_long(df, {c.pos: c.number for c in types})
    found = {r["pos"]: r.asDict() for r in moments(long).collect()}
    sizes = {pos: m["n_valid"] for pos, m in found.items()}
    for row in exact_quantiles(long, [0.25, 0.75], sizes).collect():
        found[row["pos"]].update(q1=row["q"][0], q3=row["q"][1])
    for row in spread_metrics(long, found).collect():
        found[row["pos"]].update(row.asDict())
    return metric_rows(_partial(df, types, found), OUTLIERS)


@query(
    "exact_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{name}' AS quantile,"
        f" round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS value FROM lineitem"
        for c in CONTINUOUS
        for name, p in zip(QUANTILE_NAMES, PROBABILITIES)
    ),
)
def narrowed_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by narrowing, the way taken for columns beyond a million rows."""
    df = load(spark, sf_dir, LINEITEM)
    long = to_long(df, {i: F.col(c).cast("double") for i, c in enumerate(CONTINUOUS)})
    sizes = dict.fromkeys(range(len(CONTINUOUS)), df.count())
    found = exact_quantiles(long, PROBABILITIES, sizes, direct_rows=5_000)
    names = F.array(*[F.lit(c) for c in CONTINUOUS])
    rows = F.arrays_zip(F.array(*[F.lit(q) for q in QUANTILE_NAMES]).alias("quantile"), F.col("q"))
    return found.select(
        F.element_at(names, F.col("pos") + 1).alias("column"), F.inline(rows)
    ).select("column", F.col("quantile"), rounded(F.col("q")).alias("value"))


FLAGS = ["n_unique_vals", "is_discrete", "zero_count", "negative_count"]


@query("discrete_flags", metrics_sql(LINEITEM, FLAGS, LINEITEM.of(N)))
def discrete_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, LINEITEM)
    types = typed(df, LINEITEM, LINEITEM.of(N))
    long = to_long(df, {c.pos: c.number for c in types})
    found = {r["pos"]: r.asDict() for r in moments(long).collect()}
    for row in distinct_counts(long).collect():
        found[row["pos"]]["n_unique_vals"] = row["n_unique"]
    return metric_rows(_partial(df, types, found), FLAGS)


@query(
    "monotonic_flags",
    'WITH prof AS (' + profile_sql(ORDERS, ORDERS.of(N)) + " UNION ALL BY NAME "
    + profile_sql(PART, PART.of(N))
    + ') SELECT "column", CAST(monotonic_inc AS INT) AS rising,'
    " CAST(monotonic_dec AS INT) AS falling FROM prof",
)
def monotonic_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for dataset in (ORDERS, PART):
        df = load(spark, sf_dir, dataset)
        names = dataset.of(N)
        values = {i: F.col(n).cast("double") for i, n in enumerate(names)}
        flags = monotonic_flags(df, values, dataset.order)
        rows += [(names[i], int(up), int(down)) for i, (up, down) in flags.items()]
    return small_table(spark, rows, "column string, rising int, falling int")


# table, order and date column: as given, and in the order of the dates themselves
DATE_ORDERS = [
    ("orders", "o_orderkey", "o_orderdate"),
    ("orders", "o_orderdate", "o_orderdate"),
    ("events", "event_id", "ts"),
    ("events", "ts", "ts"),
]


@query(
    "date_order",
    " UNION ALL ".join(
        f"""SELECT '{name} by {key}' AS "case", CAST(coalesce(bool_and(v >= earlier), true) AS INT)
 AS input_is_sorted, CAST(coalesce(bool_and(v <= earlier), true) AS INT) AS falling FROM
 (SELECT {value} AS v, lag({value}) OVER (ORDER BY {key}) AS earlier
  FROM {name} WHERE {value} IS NOT NULL)"""
        for name, key, value in DATE_ORDERS
    ),
)
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, key, value in DATE_ORDERS:
        df = table(spark, sf_dir, name)
        c = ColumnType(value, 0, df.schema[value].dataType, "date")
        rising, falling = monotonic_flags(df, {0: c.timestamp}, [key])[0]
        rows.append((f"{name} by {key}", int(rising), int(falling)))
    return small_table(spark, rows, "case string, input_is_sorted int, falling int")


def histogram_sql(relation: str, column: str, bins: str) -> str:
    """Equal-width histogram with edges; ``bins`` is an expression over n, lo, hi, q1, q3."""
    return f"""
WITH src AS (SELECT CAST({column} AS DOUBLE) AS v FROM {relation} WHERE {column} IS NOT NULL),
 s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1,
   quantile_cont(v, 0.75) AS q3 FROM src),
 r AS (SELECT lo, hi, CAST({bins} AS INTEGER) AS k FROM s),
 edges AS (SELECT b, k, lo + b * ((hi - lo) / k) AS lo,
   CASE WHEN b = k - 1 THEN hi ELSE lo + (b + 1) * ((hi - lo) / k) END AS hi
   FROM r, (SELECT unnest(generate_series(0, 59)) AS b) WHERE b < k)
SELECT CAST(e.b AS INTEGER) AS bin, round(e.lo, 4) AS lo, round(e.hi, 4) AS hi, count(v) AS n
FROM edges e LEFT JOIN src ON v >= e.lo AND (v < e.hi OR (e.b = e.k - 1 AND v <= e.hi))
GROUP BY e.b, e.lo, e.hi"""


FD_BINS = "greatest(5, least(60, ceil((hi - lo) / (2 * (q3 - q1) * pow(n, -1.0 / 3)))))"


def _histogram(spark: SparkSession, sf_dir: str, dataset: Dataset, column: str) -> DataFrame:
    df = load(spark, sf_dir, dataset)
    c = one(df, dataset, column)
    found = numeric_metrics(df, [c])[c.pos]
    return charts.histogram_data(df, c, found).select(
        "bin", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"), "n"
    )


@query("histogram_fd", histogram_sql("events", "value", FD_BINS))
def histogram_fd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, EVENTS, "value")


@query("histogram_many_values", histogram_sql("lineitem", "l_quantity", FD_BINS))
def histogram_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, LINEITEM, "l_quantity")


@query(
    "histogram_labels",
    "SELECT bin, replace(concat(CAST(round(lo, 0) AS VARCHAR), '–', CAST(round(hi, 0) AS VARCHAR)),"
    f" '-0.0', '0.0') AS label FROM ({histogram_sql('orders', 'o_totalprice', FD_BINS)})",
)
def histogram_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, ORDERS)
    c = one(df, ORDERS, "o_totalprice")
    return charts.histogram_data(df, c, numeric_metrics(df, [c])[c.pos]).select("bin", "label")


@query(
    "histogram_discrete",
    "SELECT CAST(row_number() OVER (ORDER BY l_linenumber) - 1 AS INTEGER) AS bin,"
    " CAST(l_linenumber AS DOUBLE) AS lo, CAST(l_linenumber AS DOUBLE) AS hi, count(*) AS n"
    " FROM lineitem GROUP BY l_linenumber",
)
def histogram_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, LINEITEM, "l_linenumber")


def box_sql(relation: str, column: str, order: str) -> str:
    return f"""
WITH src AS (SELECT CAST({column} AS DOUBLE) AS v, {order} AS k FROM {relation}),
 s AS (SELECT min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
   quantile_cont(v, 0.75) AS q3, max(v) AS max FROM src),
 o AS (SELECT v, row_number() OVER (ORDER BY k) AS i FROM src, s
   WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))
SELECT '{column}' AS grp, min, q1, median, q3, max,
 coalesce((SELECT count(*) FROM o WHERE i <= 30), 0) AS n_listed,
 (SELECT round(sum(v), 4) FROM o WHERE i <= 30) AS sum_listed FROM s"""


@query("box_summary", box_sql("events", "value", "event_id"))
def box_of_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, EVENTS)
    c = one(df, EVENTS, "value")
    box = charts.box_data(df, c, {"n_valid": c.present}, EVENTS.order)
    return box_columns(box)


def box_columns(box: DataFrame) -> DataFrame:
    listed = F.aggregate("outliers", F.lit(0.0), lambda a, v: a + v)
    count = F.size("outliers").cast("long")
    return box.select(
        "grp", "min", "q1", "median", "q3", "max", count.alias("n_listed"),
        F.when(count > 0, F.round(listed, 4)).alias("sum_listed"),
    )


def density_sql(grouped: str) -> str:
    """Density curves of (grp, v)."""
    return f"""
WITH src AS ({grouped}),
 s AS (SELECT grp, min(v) AS lo, max(v) AS hi, count(*) AS n,
   stddev_samp(v) * pow(count(*), -0.2) AS h FROM src GROUP BY grp),
 g AS (SELECT s.*, CAST(i AS INTEGER) AS point, lo + i / 59.0 * (hi - lo) AS x
   FROM s, (SELECT unnest(generate_series(0, 59)) AS i))
SELECT g.grp, point, round(x, 4) AS x,
 round(sum(exp(-0.5 * pow((v - x) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g JOIN src ON src.grp = g.grp GROUP BY g.grp, point, x, n, h"""


def density_columns(curves: DataFrame) -> DataFrame:
    return curves.select(
        "grp", "point", rounded(F.col("x")).alias("x"), rounded(F.col("density"), 6).alias("density")
    )


@query("kde_curve", density_sql("SELECT 'value' AS grp, value AS v FROM events"))
def kde_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, EVENTS)
    return density_columns(charts.violin_data(df, one(df, EVENTS, "value")))


# categories ---------------------------------------------------------------------------

CATEGORY = ["unique_count", "cardinality_ratio", "dominant_rate", "categorical_entropy",
            "normalised_entropy", "balance_score", "gini_impurity", "n_valid"]


@query("categorical_profile", metrics_sql(PART, CATEGORY, PART.of(C)))
def categorical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    types = typed(df, PART, PART.of(C))
    return metric_rows(_partial(df, types, categorical_metrics(df, types)), CATEGORY)


@query(
    "top_values",
    "WITH f AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part GROUP BY {c}"
        for c in PART.of(C)
    )
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS i"
    ' FROM f) SELECT "column", value, n, CAST(i AS INTEGER) AS rank FROM r WHERE i <= 10',
)
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    names = PART.of(C)
    counts = value_counts(to_long(df, {i: F.col(n) for i, n in enumerate(names)}), "pos", "value")
    labels = F.array(*[F.lit(n) for n in names])
    return (
        ranked(counts, ["pos"])
        .where(F.col("rank") <= 10)
        .select(F.element_at(labels, F.col("pos") + 1).alias("column"), "value", "n", "rank")
    )


def _top_sql(relation: str, column: str, k: int) -> str:
    return (
        f"SELECT {column} AS label, count(*) AS n FROM {relation} GROUP BY {column}"
        f" ORDER BY n DESC, label LIMIT {k}"
    )


@query("bar_topk", _top_sql("part", "p_brand", 20))
def bar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    return charts.bar_data(df, one(df, PART, "p_brand"))


@query("lollipop_topk", _top_sql("documents", "source", 20))
def lollipop_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, LABELLED)
    return charts.lollipop_data(df, one(df, LABELLED, "source"))


@query("treemap_topk", _top_sql("events", "props", 30))
def treemap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, EVENTS)
    return charts.bar_data(df, one(df, EVENTS, "props"), charts.TREEMAP_TOP)


@query(
    "pie_other",
    "WITH r AS (SELECT p_brand AS v, count(*) AS n,"
    " row_number() OVER (ORDER BY count(*) DESC, p_brand) AS i FROM part GROUP BY p_brand)"
    " SELECT CASE WHEN i > 8 THEN 'Other' ELSE v END AS label, CAST(sum(n) AS BIGINT) AS n"
    " FROM r GROUP BY least(i, 9), label",
)
def pie_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    return charts.pie_data(df, one(df, PART, "p_brand"))


# dates, texts, types ------------------------------------------------------------------

DATES = ["range_days", "unique_dates", "median_gap_days", "regularity_pct", "n_valid"]
DISTINCT_DATES = "(SELECT DISTINCT {0} AS {1} FROM orders)"


def _distinct_dates(name: str, expression: str) -> Dataset:
    return Dataset(name, DISTINCT_DATES.format(expression, name), {name: "date"}, (name,))


DAYS = _distinct_dates("order_day", "o_orderdate")
MONTHS = _distinct_dates("order_month", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)")


@query(
    "date_profile",
    " UNION ALL ".join(metrics_sql(d, DATES) for d in (DAYS, MONTHS))
    + " UNION ALL " + metrics_sql(EVENTS, DATES, ["ts"]),
)
def date_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    days = orders.select(F.col("o_orderdate").alias("order_day")).distinct()
    months = orders.select(month.alias("order_month")).distinct()
    events = table(spark, sf_dir, "events").select("ts")
    out = None
    for df in (days, months, events):
        c = ColumnType(df.columns[0], 0, df.schema[0].dataType, "date")
        rows = metric_rows(_partial(df, [c], date_metrics(df, [c])), DATES)
        out = rows if out is None else out.unionByName(rows)
    return out


TEXT_METRICS = ["unique_count", "avg_length", "median_length", "max_length", "min_length",
                "blank_count", "blank_rate", "n_valid"]


@query(
    "text_profile",
    metrics_sql(LABELLED, TEXT_METRICS, ["text"]) + " UNION ALL "
    + metrics_sql(CONVERSATIONS, TEXT_METRICS, ["text"]).replace("'text' AS \"column\"", "'reply' AS \"column\""),
)
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, column in (("documents", "text"), ("conversations", "reply")):
        df = table(spark, sf_dir, name).select(F.col("text").alias(column))
        types = detect_types(df)
        rows = metric_rows(_partial(df, types, text_metrics(df, types)), TEXT_METRICS)
        out = rows if out is None else out.unionByName(rows)
    return out


NUMBER_SQL = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def _kind_sql(expression: str, relation: str, order: str, name: str) -> str:
    """Type of a text column, by the rules: numbers, dates, then number of values."""
    return f"""
SELECT '{name}' AS "column", CASE
 WHEN avg(CASE WHEN regexp_matches(replace(v, ',', ''), '{NUMBER_SQL}') THEN 1.0 ELSE 0.0 END) >= 0.9
   THEN 'numeric'
 WHEN bool_and(CASE WHEN i <= 30 THEN regexp_full_match(v, '\\d{{4}}-\\d\\d-\\d\\d')
   OR regexp_full_match(v, '\\d\\d/\\d\\d/\\d{{4}}') ELSE true END) THEN 'date'
 WHEN count(DISTINCT v) <= 100 AND count(DISTINCT v) * 1.0 / count(v) < 0.5 THEN 'categorical'
 ELSE 'text' END AS type
FROM (SELECT v, row_number() OVER (ORDER BY k) AS i FROM
 (SELECT {expression} AS v, {order} AS k FROM {relation}) WHERE v IS NOT NULL)"""


@query(
    "type_detection",
    " UNION ALL ".join(
        (
            _kind_sql("CAST(o_orderkey AS VARCHAR)", "orders", "o_orderkey", "key_text"),
            _kind_sql(
                "format('{:,}', CAST(floor(o_totalprice) AS BIGINT))", "orders", "o_orderkey",
                "price_text",
            ),
            _kind_sql("strftime(o_orderdate, '%Y-%m-%d')", "orders", "o_orderkey", "iso_text"),
            _kind_sql("strftime(o_orderdate, '%m/%d/%Y')", "orders", "o_orderkey", "us_text"),
            _kind_sql("o_orderpriority", "orders", "o_orderkey", "priority_text"),
            _kind_sql(
                "concat('order ', CAST(o_orderkey AS VARCHAR))", "orders", "o_orderkey", "name_text"
            ),
            _kind_sql(
                "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END",
                "orders", "o_orderkey", "mixed_text",
            ),
        )
    ),
)
def type_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    texts = df.select(
        key.cast("string").alias("key_text"),
        F.format_number(F.floor("o_totalprice"), 0).alias("price_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_text"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_text"),
        F.col("o_orderpriority").alias("priority_text"),
        F.concat(F.lit("order "), key.cast("string")).alias("name_text"),
        F.when(key % 5 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mixed_text"),
        key,
    )
    types = detect_types(texts, ["o_orderkey"])
    return types_frame(texts, types).where("column != 'o_orderkey'").select("column", "type")


@query(
    "number_parsing",
    "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(floor(o_totalprice)), 2) AS total"
    " FROM orders GROUP BY o_orderpriority",
)
def number_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written with thousands commas, read back and summed."""
    df = table(spark, sf_dir, "orders")
    text = F.format_number(F.floor("o_totalprice"), 0)
    return df.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(parse_number(text)).alias("n"), F.round(F.sum(parse_number(text)), 2).alias("total")
    )


@query(
    "date_parsing",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1",
)
def date_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written month first, read back and counted."""
    df = table(spark, sf_dir, "orders")
    parsed: Column = parse_date(F.date_format("o_orderdate", "MM/dd/yyyy"), "M/d/yyyy")
    return df.groupBy(F.date_format(parsed, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )


# missing values and row order ---------------------------------------------------------

MISSING = ["total", "missing", "missing_rate"]


@query("missing_profile", metrics_sql(LABELLED, MISSING))
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, LABELLED)
    return metric_rows(_partial(df, detect_types(df, LABELLED.order), {}), MISSING)


@query(
    "quality_summary",
    f"WITH prof AS ({profile_sql(LABELLED)})"
    " SELECT CAST(max(total) AS BIGINT) AS rows, count(*) AS columns,"
    + ", ".join(
        f" CAST(count_if(type = '{k}') AS BIGINT) AS {k}_columns" for k in ("numeric", "categorical", "date", "text")
    )
    + ", CAST(sum(missing) AS BIGINT) AS total_missing_cells,"
    " round(sum(missing) * 100.0 / sum(total), 2) AS overall_missing_pct,"
    " CAST(count_if(missing = 0) AS BIGINT) AS complete_columns FROM prof",
)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, LABELLED)
    return quality_summary(_partial(df, detect_types(df, LABELLED.order), {}))


@query(
    "row_ordinal",
    "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS rid FROM events",
)
def row_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return with_ordinal(df, ["value", "event_id"], "rid").select("event_id", "rid")


SAMPLE_SQL = (
    "WITH r AS ({rows}), s AS (SELECT greatest(1, count(*) // {points}) AS step FROM r)"
    " SELECT {columns} FROM r, s WHERE rid % step = 0"
)


@query(
    "systematic_sample",
    SAMPLE_SQL.format(
        rows="SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid"
        " FROM orders",
        points=200,
        columns="o_orderkey, o_totalprice",
    ),
)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return every_nth(with_ordinal(df, ["o_orderkey"]), df.count(), 200).drop("_rid")


@query(
    "index_line",
    "WITH a AS (SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS row, l.quality AS v"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),"
    " b AS (SELECT row, CAST(v AS DOUBLE) AS value, row_number() OVER (ORDER BY row) - 1 AS i"
    " FROM a WHERE v IS NOT NULL),"
    " s AS (SELECT greatest(1, count(*) // 200) AS step FROM b)"
    " SELECT row, value FROM b, s WHERE i % step = 0",
)
def index_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions count the values present; row numbers count all rows."""
    df = load(spark, sf_dir, LABELLED)
    return charts.index_line(df, one(df, LABELLED, "quality"), LABELLED.order)


@query(
    "missing_mask",
    SAMPLE_SQL.format(
        rows="SELECT d.doc_id, CAST(d.text IS NULL AS INT) AS text_gap,"
        " CAST(l.quality IS NULL AS INT) AS quality_gap,"
        " row_number() OVER (ORDER BY d.doc_id) - 1 AS rid"
        " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        points=100,
        columns="rid, text_gap, quality_gap",
    ),
)
def missing_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, LABELLED).select("doc_id", "text", "quality")
    return charts.missing_mask(df, ["doc_id"]).select(
        F.col("_rid").alias("rid"),
        F.col("text").alias("text_gap"),
        F.col("quality").alias("quality_gap"),
    )


@query(
    "timeline",
    "WITH r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) - 1 AS i FROM orders),"
    " s AS (SELECT greatest(1, count(*) // 200) AS step FROM r)"
    " SELECT CAST(i // step AS BIGINT) AS point, strftime(o_orderdate, '%Y-%m-%d') AS day"
    " FROM r, s WHERE i % step = 0",
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, ORDERS)
    points = charts.timeline(df, one(df, ORDERS, "o_orderdate"))
    return points.select("point", F.date_format("ts", "yyyy-MM-dd").alias("day"))


__all__ = ["box_columns", "column_metrics", "density_columns", "one", "typed"]

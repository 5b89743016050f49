"""Queries about pairs of columns: correlations, fits, samples, groups and cross tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulens.functions.numbers import rounded
from tabulens.operators import groups, sampling
from tabulens.operators.correlation import correlation_pairs, line_fit
from tabulens.operators.quantiles import exact_quantiles
from tabulens.plans import charts
from tabulens.plans.profile import column_metrics
from tabulens.plans.types import detect_types
from verification.column_queries import (
    box_columns,
    density_columns,
    density_sql,
    one,
    typed,
)
from verification.datasets import EVENTS, LABELLED, LINEITEM, N, ORDERS, PART, load, table
from verification.registry import query


def _pairs_sql(relation: str, columns: list[str], digits: int) -> str:
    """(a, b, r) for every pair in column order, over the rows where both are present."""
    parts = [
        f"SELECT '{a}' AS col_a, '{b}' AS col_b,"
        f" round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), {digits}) + 0.0 AS r FROM {relation}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return " UNION ALL ".join(parts)


@query("correlation_pairs", _pairs_sql("lineitem", LINEITEM.of(N), 4))
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, LINEITEM)
    names = LINEITEM.of(N)
    values = {i: F.col(n).cast("double") for i, n in enumerate(names)}
    return _named(correlation_pairs(df, values), names)


def _named(found: DataFrame, names: list[str]) -> DataFrame:
    labels = F.array(*[F.lit(n) for n in names])
    return found.select(
        F.element_at(labels, F.col("pos_a") + 1).alias("col_a"),
        F.element_at(labels, F.col("pos_b") + 1).alias("col_b"),
        rounded(F.col("r")).alias("r"),
    )


@query("correlation_pairs_wide", _pairs_sql(LABELLED.relation, LABELLED.of(N), 4))
def wide_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken for tables with many numeric columns, here with gaps."""
    df = load(spark, sf_dir, LABELLED)
    names = LABELLED.of(N)
    values = {i: F.col(n).cast("double") for i, n in enumerate(names)}
    return _named(correlation_pairs(df, values, most_sums=0), names)


@query(
    "correlation_matrix",
    f"WITH p AS ({_pairs_sql(LABELLED.relation, LABELLED.of(N), 3)})"
    " SELECT col_a, col_b, r FROM p UNION ALL SELECT col_b, col_a, r FROM p UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in LABELLED.of(N)),
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise-complete: some columns have gaps."""
    df = load(spark, sf_dir, LABELLED)
    types = typed(df, LABELLED)
    spread = [{"position": c.pos, "std": 1.0} for c in types]
    return charts.correlation_data(df, types, spread, charts.correlations(df, types))


@query(
    "ols_trend",
    "SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(x0, 4) AS x_start,"
    " round(x1, 4) AS x_end, round(slope * x0 + intercept, 4) AS y_start,"
    " round(slope * x1 + intercept, 4) AS y_end FROM (SELECT regr_slope(y, x) AS slope,"
    " regr_intercept(y, x) AS intercept, min(x) AS x0, max(x) AS x1 FROM"
    " (SELECT CAST(p_partkey AS DOUBLE) AS x, p_retailprice AS y FROM part))",
)
def ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    return line_fit(charts.points(df, one(df, PART, "p_partkey"), one(df, PART, "p_retailprice")))


SAMPLE = (
    "SELECT CAST(user_id AS DOUBLE) AS x, value AS y, event_id FROM events"
    " ORDER BY md5(concat('42|', CAST(event_id AS VARCHAR))), event_id LIMIT 600"
)


@query("scatter_sample", f"SELECT x, y FROM ({SAMPLE})")
def scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, EVENTS)
    x, y = one(df, EVENTS, "user_id"), one(df, EVENTS, "value")
    return charts.scatter_data(df, x, y, EVENTS.order).select("x", "y")


def _beyond_sql(column: str) -> str:
    return (
        f"({column} < (SELECT quantile_cont({column}, 0.25) * 2.5 - quantile_cont({column}, 0.75) * 1.5"
        f" FROM s) OR {column} > (SELECT quantile_cont({column}, 0.75) * 2.5"
        f" - quantile_cont({column}, 0.25) * 1.5 FROM s))"
    )


@query(
    "scatter_outliers",
    f"WITH s AS ({SAMPLE}) SELECT x, y FROM s WHERE {_beyond_sql('x')} OR {_beyond_sql('y')}"
    " ORDER BY event_id LIMIT 50",
)
def scatter_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, EVENTS)
    x, y = one(df, EVENTS, "user_id"), one(df, EVENTS, "value")
    return charts.scatter_outlier_data(df, x, y, EVENTS.order)


@query(
    "all_outliers",
    "WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"
    " SELECT event_id, value FROM events, s"
    " WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
)
def all_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row beyond the fences of the whole column."""
    df = load(spark, sf_dir, EVENTS)
    long = df.select(F.lit(0).alias("pos"), "value")
    fences = exact_quantiles(long, [0.25, 0.75], {0: df.count()}).first()["q"]
    outside = sampling.beyond(F.col("value"), F.lit(fences[0]), F.lit(fences[1]))
    return df.where(outside).select("event_id", "value")


@query("xy_line", "SELECT CAST(p_partkey AS DOUBLE) AS x, p_retailprice AS y FROM part")
def xy_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    return charts.xy_line(df, one(df, PART, "p_partkey"), one(df, PART, "p_retailprice"))


@query(
    "date_value_line",
    "WITH r AS (SELECT o_orderdate, o_totalprice,"
    " row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders),"
    " s AS (SELECT greatest(1, count(*) // 200) AS step FROM r)"
    " SELECT CAST(i // step AS BIGINT) AS point, strftime(o_orderdate, '%Y-%m-%d') AS day,"
    " o_totalprice AS value FROM r, s WHERE i % step = 0",
)
def date_value_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, ORDERS)
    date, value = one(df, ORDERS, "o_orderdate"), one(df, ORDERS, "o_totalprice")
    rows = charts.dated_values(df, date, value, ORDERS.order)
    return rows.select("point", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


@query(
    "date_category_line",
    "WITH r AS (SELECT ts, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),"
    " s AS (SELECT greatest(1, count(*) // 200) AS step FROM r)"
    " SELECT CAST(i // step AS BIGINT) AS point, event_type AS value FROM r, s WHERE i % step = 0",
)
def date_category_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, EVENTS)
    rows = charts.dated_values(df, one(df, EVENTS, "ts"), one(df, EVENTS, "event_type"), EVENTS.order)
    return rows.select("point", "value")


# groups -------------------------------------------------------------------------------


@query(
    "grouped_bar",
    "SELECT p_brand AS grp, round(avg(p_retailprice), 4) AS mean,"
    " round(coalesce(stddev_samp(p_retailprice), 0), 4) AS std, count(*) AS n FROM part"
    " GROUP BY p_brand HAVING count(*) >= 5 ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 15",
)
def grouped_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    values = charts.grouped(df, one(df, PART, "p_brand"), one(df, PART, "p_retailprice"))
    return charts.grouped_bar_data(values, charts.GROUP_ROWS)


@query(
    "grouped_lollipop",
    "SELECT props AS grp, round(avg(value), 4) AS mean FROM events GROUP BY props"
    " HAVING count(*) >= 5 ORDER BY avg(value), props LIMIT 15",
)
def grouped_lollipop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, EVENTS)
    values = charts.grouped(df, one(df, EVENTS, "props"), one(df, EVENTS, "value"))
    return charts.grouped_lollipop_data(values, charts.GROUP_ROWS)


@query(
    "small_group_filter",
    "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem"
    " WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5)"
    " AND (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5)) >= 2"
    " GROUP BY l_orderkey",
)
def small_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    kept = groups.drop_small_groups(df, "l_orderkey")
    return kept.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


GROUPED_BOX = """
WITH src AS (SELECT p_brand AS grp, p_retailprice AS v, p_partkey AS k FROM part),
 t AS (SELECT grp FROM src GROUP BY grp HAVING count(*) >= 5 ORDER BY count(*) DESC, grp LIMIT 12),
 s AS (SELECT grp, min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
   quantile_cont(v, 0.75) AS q3, max(v) AS max FROM src WHERE grp IN (SELECT grp FROM t) GROUP BY grp),
 o AS (SELECT src.grp, v, row_number() OVER (PARTITION BY src.grp ORDER BY k) AS i
   FROM src JOIN s ON src.grp = s.grp WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)),
 l AS (SELECT grp, count(*) AS n, round(sum(v), 4) AS t FROM o WHERE i <= 30 GROUP BY grp)
SELECT s.grp, min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, max,
 coalesce(l.n, 0) AS n_listed, l.t AS sum_listed FROM s LEFT JOIN l ON s.grp = l.grp"""


def _box_rounded(box: DataFrame) -> DataFrame:
    out = box_columns(box)
    for name in ("q1", "median", "q3"):
        out = out.withColumn(name, rounded(F.col(name)))
    return out


@query("grouped_box", GROUPED_BOX)
def grouped_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    values = charts.grouped(df, one(df, PART, "p_brand"), one(df, PART, "p_retailprice"), PART.order)
    return _box_rounded(charts.grouped_box_data(values, PART.order, charts.GROUP_ROWS))


@query(
    "grouped_box_outliers",
    GROUPED_BOX.replace("p_brand", "event_type")
    .replace("p_retailprice", "value")
    .replace("p_partkey", "event_id")
    .replace("FROM part", "FROM events"),
)
def grouped_box_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles by narrowing, as for groups beyond a million rows; long lists of outliers."""
    df = load(spark, sf_dir, EVENTS)
    values = charts.grouped(df, one(df, EVENTS, "event_type"), one(df, EVENTS, "value"), EVENTS.order)
    sizes = groups.group_sizes(groups.top_groups(values, charts.BOX_TOP, charts.GROUP_ROWS))
    return _box_rounded(groups.box_summary(values, sizes, ["_key0"], direct_rows=500))


@query(
    "grouped_kde",
    density_sql("SELECT o_orderpriority AS grp, o_totalprice / 1000 AS v FROM orders"),
)
def grouped_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, ORDERS).withColumn("o_totalprice", F.col("o_totalprice") / 1000)
    values = charts.grouped(df, one(df, ORDERS, "o_orderpriority"), one(df, ORDERS, "o_totalprice"))
    return density_columns(charts.grouped_violin_data(values, charts.GROUP_ROWS))


def _cross_sql(x: str, y: str, relation: str, top_x: int, top_y: int) -> str:
    return f"""
WITH src AS (SELECT {x} AS grp, {y} AS other FROM {relation}),
 tx AS (SELECT grp, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, grp) AS r
   FROM src GROUP BY grp QUALIFY r <= {top_x}),
 ty AS (SELECT other, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, other) AS r
   FROM src GROUP BY other QUALIFY r <= {top_y}),
 n AS (SELECT grp, other, count(*) AS n FROM src GROUP BY grp, other)
SELECT tx.grp, ty.other, {{ranks}}coalesce(n.n, 0) AS n FROM tx CROSS JOIN ty
LEFT JOIN n ON n.grp = tx.grp AND n.other = ty.other"""


@query("crosstab_stacked", _cross_sql("p_brand", "p_type", "part", 10, 6).format(ranks=""))
def crosstab_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    pairs = charts.label_pairs(df, one(df, PART, "p_brand"), one(df, PART, "p_type"))
    return groups.crosstab(pairs, charts.STACK_X, charts.STACK_Y)


@query(
    "cat_cat_heatmap",
    _cross_sql("p_name", "p_brand", "part", 15, 15).format(
        ranks="CAST(tx.r AS INTEGER) AS x_rank, CAST(ty.r AS INTEGER) AS y_rank, "
    ),
)
def cat_cat_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    return groups.category_heatmap(
        charts.label_pairs(df, one(df, PART, "p_name"), one(df, PART, "p_brand"))
    )


@query(
    "cat_num_heatmap",
    "SELECT grp, CAST(row_number() OVER (ORDER BY n DESC, grp) AS INTEGER) AS rank, mean FROM"
    " (SELECT p_name AS grp, round(avg(p_retailprice), 4) AS mean, count(*) AS n FROM part"
    " GROUP BY p_name ORDER BY n DESC, grp LIMIT 20)",
)
def cat_num_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, PART)
    values = charts.grouped(df, one(df, PART, "p_name"), one(df, PART, "p_retailprice"))
    return charts.grouped_heatmap_data(values)


@query(
    "chosen_chart_data",
    "SELECT o_orderpriority AS grp, o_orderstatus AS other, count(*) AS n FROM orders"
    " GROUP BY o_orderpriority, o_orderstatus",
)
def chosen_chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross table asked for by name, through types and profile."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    types = detect_types(df, ["o_orderkey"])
    metrics = column_metrics(df, ["o_orderkey"], types)
    chart = charts.single_chart(df, types, metrics, "o_orderpriority", "o_orderstatus", "heatmap")
    return chart.frame.select("grp", "other", "n")

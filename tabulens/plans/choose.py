"""Which chart suits a column or a pair of columns: projections over the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulens.functions.numbers import or_zero

# Limits on the number of categories, and the other thresholds.
BINARY, GROUPS_FEW, FEW, MEDIUM, MANY = 2, 5, 6, 15, 40
OUTLIERS_HIGH, CV_HIGH, SKEW_HIGH = 5.0, 50.0, 1.0
CORRELATION_MIN, BALANCE_MIN, DOMINANT, SPARSE = 0.15, 0.25, 40, 0.8
VIOLIN_ROWS = 50

# Other charts that show the same data.
ALTERNATIVES = {
    "histogram": ["boxplot"],
    "boxplot": ["violin", "histogram"],
    "violin": ["boxplot"],
    "bar": ["lollipop", "treemap"],
    "lollipop": ["bar"],
    "pie": ["donut", "bar"],
    "donut": ["pie", "bar"],
    "treemap": ["bar", "lollipop"],
    "grouped_bar": ["boxplot", "lollipop"],
    "stacked_bar": ["grouped_bar"],
    "scatter": ["line"],
    "line": ["area", "scatter"],
    "area": ["line"],
    "heatmap": ["stacked_bar"],
}

NO_INTENT = None


def alternatives(chart: Column) -> Column:
    """Alternative charts as an array, empty for an unknown one."""
    pairs = [
        part
        for name, others in ALTERNATIVES.items()
        for part in (F.lit(name), F.array(*[F.lit(o) for o in others]))
    ]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), chart), F.array().cast("array<string>")
    )


class Side:
    """One column's metrics inside a projection, absent ones read as zero or false."""

    def __init__(self, prefix: str = "") -> None:
        def col(name: str) -> Column:
            return F.col(prefix + name)

        self.type = col("type")
        self.is_discrete_number = (self.type == "numeric") & F.coalesce(
            col("is_discrete"), F.lit(False)
        )
        self.monotonic = F.coalesce(col("monotonic"), F.lit(False))
        self.has_outliers = or_zero(col("outlier_ratio")) > OUTLIERS_HIGH
        self.high_cv = or_zero(col("cv_pct")) > CV_HIGH
        self.skewed = F.abs(or_zero(col("skewness"))) > SKEW_HIGH
        self.n = F.coalesce(col("n_valid"), F.lit(0))
        self.unique = F.coalesce(col("unique_count"), F.lit(0))
        self.balance = or_zero(col("balance_score"))
        self.cardinality = or_zero(col("cardinality_ratio"))
        self.dominant = or_zero(col("dominant_rate"))
        self.min, self.max = or_zero(col("min")), or_zero(col("max"))
        # a discrete number stands in for a category with its distinct values
        self.groups = F.when(self.is_discrete_number, col("n_unique_vals")).otherwise(self.unique)
        self.role = F.when(self.is_discrete_number, "categorical").otherwise(self.type)


def univariate_intent(s: Side) -> Column:
    """What one column is shown for, if nobody says."""
    return (
        F.when(
            s.type == "categorical",
            F.when((s.unique <= FEW) & (s.dominant >= DOMINANT), "composition").otherwise("ranking"),
        )
        .when(s.monotonic, "trend")
        .when(s.is_discrete_number, "ranking")
        .otherwise("distribution")
    )


def univariate_chart(s: Side, intent: str | None = NO_INTENT) -> Column:
    """Chart for one column, as an expression over its profile row."""
    wanted = univariate_intent(s) if intent is None else F.lit(intent)
    spread = F.when(s.has_outliers, "boxplot").otherwise("histogram")
    numeric = (
        F.when(s.is_discrete_number, spread)
        .when(wanted == "trend", "line")
        .when(wanted == "ranking", "histogram")
        .when(wanted.isin("distribution", "comparison", "correlation"), spread)
        .when(s.monotonic, "line")
        .otherwise(spread)
    )
    crowded = (s.cardinality > 0.5) | (s.unique > MEDIUM)
    balanced = s.balance >= BALANCE_MIN
    bar_or_tree = F.when(s.unique <= MEDIUM, "bar").otherwise("treemap")
    categorical = (
        F.when(
            wanted == "composition",
            F.when(crowded, "treemap").when((s.unique <= FEW) & balanced, "pie").otherwise("donut"),
        )
        .when(
            wanted == "ranking",
            F.when(s.unique <= FEW, "lollipop")
            .when(s.unique <= MEDIUM, "bar")
            .when(s.unique <= MANY, "lollipop")
            .otherwise("treemap"),
        )
        .when(wanted.isin("distribution", "comparison"), bar_or_tree)
        .when(wanted == "trend", "line")
        .when((s.unique <= FEW) & balanced, "pie")
        .otherwise(bar_or_tree)
    )
    return (
        F.when(s.type == "date", "line")
        .when(s.type == "numeric", numeric)
        .when(s.type == "categorical", categorical)
        .otherwise("table")
    )


def choose_charts(prof: DataFrame, intent: str | None = NO_INTENT) -> DataFrame:
    """(column, position, type, chart, alternatives) for every column."""
    chart = univariate_chart(Side(), intent)
    return prof.select("column", "position", "type", chart.alias("chart")).withColumn(
        "alternatives", alternatives(F.col("chart"))
    )


def worth_a_chart(x: Side, y: Side, r: Column) -> Column:
    """Whether a pair of columns is likely to show anything."""
    both_numeric = (x.type == "numeric") & (y.type == "numeric")
    dates = (x.type == "date").cast("int") + (y.type == "date").cast("int")
    two_categories = (x.role == "categorical") & (y.role == "categorical")
    too_fine = (x.cardinality > SPARSE) | (y.cardinality > SPARSE)
    too_wide = (x.unique > MANY) & (y.unique > MANY)
    supported = ["numeric", "categorical", "date"]
    return (
        F.when(~(x.type.isin(*supported) & y.type.isin(*supported)), False)
        .when(dates == 2, False)
        .when(dates == 1, True)
        .when(both_numeric, F.coalesce(F.abs(r) >= CORRELATION_MIN, F.lit(True)))
        .when(two_categories, ~(too_fine | too_wide))
        # the raw distinct count: a discrete number has none and does not pass
        .when(x.role == "categorical", x.unique >= BINARY)
        .when(y.role == "categorical", y.unique >= BINARY)
        .otherwise(True)
    )


def _category_number(groups: Column, number: Side, intent: str | None) -> Column:
    proportion = (number.min >= 0) & (
        (number.max <= 1.01) | ((number.max <= 100) & (number.max - number.min <= 100))
    )
    inferred = (
        F.when((groups <= FEW) & proportion, "composition")
        .when(groups <= GROUPS_FEW, "distribution")
        .otherwise("comparison")
    )
    wanted = inferred if intent is None else F.lit(intent)
    uneven = number.has_outliers | number.high_cv
    medium = F.when(uneven, "boxplot").otherwise("grouped_bar")
    return (
        F.when(wanted == "ranking", F.when(groups <= MEDIUM, "lollipop").otherwise("bar"))
        .when(
            wanted == "distribution", F.when(groups <= GROUPS_FEW, "violin").otherwise("boxplot")
        )
        .when(
            wanted == "comparison",
            F.when(groups <= FEW, F.when(uneven | number.skewed, "boxplot").otherwise("grouped_bar"))
            .when(groups <= MEDIUM, medium)
            .otherwise("boxplot"),
        )
        .when(wanted == "trend", "line")
        .when(groups <= FEW, F.when(number.n >= VIOLIN_ROWS, "violin").otherwise("grouped_bar"))
        .when(groups <= MEDIUM, medium)
        .otherwise("boxplot")
    )


def bivariate_chart(x: Side, y: Side, intent: str | None = NO_INTENT) -> Column:
    """Chart for a pair of columns; ``skip`` if none suits."""
    number_cv = F.when(x.type == "date", y.high_cv).otherwise(x.high_cv)
    trend = x.monotonic | y.monotonic | F.lit(intent == "trend")
    most = F.greatest(x.groups, y.groups)
    two_categories = (
        F.when(most <= BINARY, "grouped_bar").when(most <= MEDIUM, "stacked_bar").otherwise("heatmap")
    )
    return (
        F.when(
            (x.type == "date") | (y.type == "date"), F.when(number_cv, "area").otherwise("line")
        )
        .when(
            (x.type == "numeric") & (y.type == "numeric"),
            F.when(trend, "line").otherwise("scatter"),
        )
        .when(
            (x.role == "categorical") & (y.role == "numeric"),
            _category_number(x.groups, y, intent),
        )
        .when(
            (y.role == "categorical") & (x.role == "numeric"),
            _category_number(y.groups, x, intent),
        )
        .when((x.role == "categorical") & (y.role == "categorical"), two_categories)
        .otherwise("skip")
    )


def column_pairs(prof: DataFrame, correlations: DataFrame | None = None) -> DataFrame:
    """Every pair of profile rows in column order, as ``x_*`` and ``y_*``, with ``r``.

    The profile has one row per column, so this pairs a few hundred rows at most.
    """
    x = prof.select(*[F.col(c).alias(f"x_{c}") for c in prof.columns])
    y = prof.select(*[F.col(c).alias(f"y_{c}") for c in prof.columns])
    pairs = x.join(F.broadcast(y), F.col("x_position") < F.col("y_position"))
    if correlations is None:
        return pairs.withColumn("r", F.lit(None).cast("double"))
    r = correlations.select(
        F.col("pos_a").alias("x_position"),
        F.col("pos_b").alias("y_position"),
        F.round("r", 4).alias("r"),
    )
    return pairs.join(F.broadcast(r), ["x_position", "y_position"], "left")


def choose_pair_charts(
    prof: DataFrame, correlations: DataFrame | None = None, intent: str | None = NO_INTENT
) -> DataFrame:
    """(col_x, col_y, x_position, y_position, r, keep, chart, roles, built, alternatives).

    ``chart`` is the chosen chart and ``built`` what its data holds: a discrete number
    paired with a number is chosen as a scatter or line but built from its groups.
    """
    x, y = Side("x_"), Side("y_")
    chosen = column_pairs(prof, correlations).select(
        F.col("x_column").alias("col_x"),
        F.col("y_column").alias("col_y"),
        "x_position",
        "y_position",
        "r",
        worth_a_chart(x, y, F.col("r")).alias("keep"),
        bivariate_chart(x, y, intent).alias("chart"),
        _pair_roles(x, y).alias("roles"),
    )
    return chosen.withColumn("built", built_chart(F.col("chart"), F.col("roles"))).withColumn(
        "alternatives", alternatives(F.col("chart"))
    )


def _pair_roles(x: Side, y: Side) -> Column:
    dated = (x.type == "date") | (y.type == "date")
    return (
        F.when(dated, "date")
        .when((x.role == "numeric") & (y.role == "numeric"), "numbers")
        .when((x.role == "categorical") & (y.role == "numeric"), "category_number")
        .when((x.role == "numeric") & (y.role == "categorical"), "number_category")
        .when((x.role == "categorical") & (y.role == "categorical"), "categories")
        .otherwise("none")
    )


def built_chart(chart: Column, roles: Column) -> Column:
    """The kind of data behind a chosen chart, given what the two columns act as."""
    return (
        F.when(roles == "none", None)
        .when(roles == "date", F.when(chart == "area", "area").otherwise("line"))
        .when(roles == "numbers", F.when(chart == "line", "line").otherwise("scatter"))
        .when(
            roles == "categories",
            F.when(chart == "heatmap", "heatmap").otherwise("stacked_bar"),
        )
        .when(chart.isin("lollipop", "boxplot", "violin", "heatmap"), chart)
        .otherwise("bar")
    )

"""Ranked findings about a table, from its profile, importance and correlations.

All inputs have one row per column or pair of columns; no table data is read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulens.functions.numbers import or_zero
from tabulens.functions.text import quoted_list, fixed

# How many findings are kept, and how many pairs and columns a finding lists.
MOST_FINDINGS, STRONG_PAIRS, MODERATE_PAIRS, LISTED_COLUMNS = 40, 5, 4, 5

SEVERITIES = ("high", "medium", "low")


def find_insights(
    prof: DataFrame, importance: DataFrame, correlations: DataFrame | None = None
) -> DataFrame:
    """(rank, text, category, severity, cols): the 40 foremost findings.

    ``correlations`` holds (pos_a, pos_b, r). High severity comes first, then categories in
    alphabetical order, then the order in which the rules and columns come.
    """
    found = quality_findings(prof).unionByName(column_findings(prof))
    found = found.unionByName(importance_findings(importance))
    if correlations is not None:
        found = found.unionByName(correlation_findings(prof, correlations))
    first = Window.partitionBy("text").orderBy("part", "position", "rule")
    severity = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    order = Window.partitionBy(F.lit(1)).orderBy(severity, "category", "part", "position", "rule")
    return (
        found.withColumn("_seen", F.row_number().over(first))
        .where(F.col("_seen") == 1)
        .withColumn("rank", F.row_number().over(order))  # a few findings per column
        .where(F.col("rank") <= MOST_FINDINGS)
        .select("rank", "text", "category", "severity", "cols")
    )


def _finding(
    rule: int, when: Column, category: str, severity: str, text: Column, cols: Column, part: int = 0
) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(part).alias("part"),
            F.lit(rule).alias("rule"),
            F.lit(category).alias("category"),
            F.lit(severity).alias("severity"),
            text.alias("text"),
            cols.alias("cols"),
        ),
    )


def _listed(rows: DataFrame, position: Column, findings: list[Column]) -> DataFrame:
    """One row per finding that applies."""
    kept = rows.select(position.alias("position"), F.array_compact(F.array(*findings)).alias("f"))
    return kept.select("position", F.inline("f"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _when(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, yes).otherwise(no)


# Thresholds and texts below are fixed values.


def quality_findings(prof: DataFrame) -> DataFrame:
    """One finding each for all columns that lack values, vary little or identify rows."""
    rate, column = F.col("missing_rate"), F.col("column")

    def matching(condition: Column) -> Column:
        entry = F.struct("position", column.alias("column"), rate.alias("rate"))
        return F.sort_array(F.collect_list(F.when(condition, entry)))

    numeric, categorical = F.col("type") == "numeric", F.col("type") == "categorical"
    constant = (or_zero(F.col("cv_pct")) < 0.5) & (F.coalesce("n_valid", F.lit(0)) > 5)
    lists = prof.agg(
        matching(rate >= 50).alias("heavy"),
        matching((rate >= 20) & (rate < 50)).alias("moderate"),
        matching(numeric & constant).alias("constant"),
        matching(categorical & (or_zero(F.col("cardinality_ratio")) > 0.9)).alias("ids"),
    )

    def names(group: str) -> Column:
        return F.transform(group, lambda c: c["column"])

    def rates(group: str) -> Column:
        return F.array_join(
            F.transform(group, lambda c: _text(c["column"], " (", fixed(c["rate"]), "%)")),
            ", ",
        )

    def count(group: str) -> Column:
        return F.size(group).cast("string")

    quality = "data_quality"
    return _listed(
        lists,
        F.lit(0),
        [
            _finding(
                1, F.size("heavy") > 0, quality, "high",
                _text(
                    count("heavy"), " column(s) have >50% missing values: ", rates("heavy"),
                    ". Consider dropping or imputing them before modelling.",
                ),
                names("heavy"),
            ),
            _finding(
                2, F.size("moderate") > 0, quality, "medium",
                _text(count("moderate"), " column(s) have notable missing data: ",
                      rates("moderate"), "."),
                names("moderate"),
            ),
            _finding(
                3, F.size("constant") > 0, quality, "high",
                _text(
                    "Column(s) ", F.array_join(names("constant"), ", "),
                    " appear near-constant (CV < 0.5%). ",
                    "They carry almost no signal for analysis or modelling.",
                ),
                names("constant"),
            ),
            _finding(
                4, F.size("ids") > 0, quality, "medium",
                _text(
                    "Column(s) ", F.array_join(names("ids"), ", "), " look like identifier fields ",
                    "(almost every value is unique). ",
                    "They should be excluded from statistical analysis.",
                ),
                names("ids"),
            ),
        ],
    )


def column_findings(prof: DataFrame) -> DataFrame:
    """Findings about single columns: distribution, categories and trends."""
    return _listed(
        prof, F.col("position"), _distribution_rules() + _categorical_rules() + _trend_rules()
    )


def _distribution_rules() -> list[Column]:
    is_numeric = F.col("type") == "numeric"
    skew, kurt = or_zero(F.col("skewness")), or_zero(F.col("kurtosis"))
    rate, cv = or_zero(F.col("outlier_ratio")), or_zero(F.col("cv_pct"))
    rows = F.coalesce("outliers_iqr", F.lit(0)).cast("string")
    name, cols = _text("'", F.col("column"), "'"), F.array("column")
    kind = "distribution"
    return [
        _finding(
            1, is_numeric & (F.abs(skew) >= 2), kind, "high",
            _text(
                name, " is heavily ", _when(skew > 0, "right (positively)", "left (negatively)"),
                " skewed (skewness = ", fixed(skew, 2), "). ",
                "A log or square-root transformation may improve model performance.",
            ),
            cols,
        ),
        _finding(
            2, is_numeric & (F.abs(skew) >= 1) & (F.abs(skew) < 2), kind, "medium",
            _text(name, " shows moderate ", _when(skew > 0, "right", "left"), " skew (",
                  fixed(skew, 2), ")."),
            cols,
        ),
        _finding(
            3, is_numeric & (rate >= 15), kind, "high",
            _text(
                name, " has a very high outlier rate: ", fixed(rate, 1), "% of values (", rows,
                " rows) fall outside the IQR fence. Investigate before modelling.",
            ),
            cols,
        ),
        _finding(
            4, is_numeric & (rate >= 5) & (rate < 15), kind, "medium",
            _text(name, " contains notable outliers (", fixed(rate, 1), "%, ", rows, " rows)."),
            cols,
        ),
        _finding(
            5, is_numeric & (kurt > 5), kind, "medium",
            _text(
                name, " has very heavy tails (excess kurtosis = ", fixed(kurt, 2), "). ",
                "Extreme values are much more common than a normal distribution would predict.",
            ),
            cols,
        ),
        _finding(
            6, is_numeric & (cv > 100), kind, "medium",
            _text(
                name, " has extremely high relative variability (CV = ", fixed(cv), "%). ",
                "The spread is larger than the mean — check for mixed populations.",
            ),
            cols,
        ),
    ]


def _categorical_rules() -> list[Column]:
    is_category = F.col("type") == "categorical"
    share, unique = or_zero(F.col("dominant_rate")), F.coalesce("unique_count", F.lit(0))
    cardinality = or_zero(F.col("cardinality_ratio"))
    value = F.coalesce("dominant_value", F.lit(""))
    name, cols = _text("'", F.col("column"), "'"), F.array("column")
    kind = "categorical"
    return [
        _finding(
            1, is_category & (share >= 90), kind, "high",
            _text(
                name, " is dominated by one value: '", value, "' accounts for ",
                fixed(share), "% of all rows. ",
                "The column has very little discriminating power.",
            ),
            cols,
        ),
        _finding(
            2, is_category & (share >= 70) & (share < 90), kind, "medium",
            _text(name, " is skewed — '", value, "' covers ", fixed(share), "% of rows."),
            cols,
        ),
        _finding(
            3, is_category & (unique == 2), kind, "low",
            _text(
                name, " is binary with values ", quoted_list(F.col("top_values")), ". ",
                "It can be directly used as a feature or target variable.",
            ),
            cols,
        ),
        _finding(
            4, is_category & (cardinality > 0.5) & (cardinality <= 0.9), kind, "medium",
            _text(
                name, " has high cardinality (", unique.cast("string"), " unique values, ",
                fixed(cardinality * 100), "% of rows). Consider grouping rare categories.",
            ),
            cols,
        ),
    ]


def _trend_rules() -> list[Column]:
    is_date, is_numeric = F.col("type") == "date", F.col("type") == "numeric"
    freq, regularity = F.col("inferred_freq"), F.col("regularity_pct")
    days = F.coalesce("range_days", F.lit(0)).cast("string")
    rising = F.coalesce("monotonic_inc", F.lit(False))
    falling = F.coalesce("monotonic_dec", F.lit(False))
    name, cols = _text("'", F.col("column"), "'"), F.array("column")
    return [
        _finding(
            1, is_date & freq.isNotNull(), "trend", "medium",
            _text(
                name, " appears to follow a ", freq, " cadence spanning ", days, " days. ",
                "Time-series analysis is applicable.",
            ),
            cols,
        ),
        _finding(
            2, is_date & (regularity < 50), "trend", "medium",
            _text(
                name, " has irregular intervals (only ", fixed(regularity),
                "% of gaps are regular). Resampling may be needed before time-series modelling.",
            ),
            cols,
        ),
        # dates come before numbers
        _finding(
            3, is_numeric & rising, "trend", "low",
            _text(
                name, " is strictly increasing across the dataset — ",
                "possibly a cumulative metric or time-indexed counter.",
            ),
            cols, part=1,
        ),
        _finding(
            4, is_numeric & falling & ~rising, "trend", "low",
            _text(name, " is strictly decreasing — check if it represents a declining measure."),
            cols, part=1,
        ),
    ]


def correlation_findings(prof: DataFrame, correlations: DataFrame) -> DataFrame:
    """The five strongest pairs, and one finding for the moderate ones."""
    names = prof.select("position", "column")
    pairs = (
        correlations.select("pos_a", "pos_b", F.round("r", 3).alias("r"))
        .where(F.abs("r") >= 0.4)
        .join(F.broadcast(names.toDF("pos_a", "a")), "pos_a")
        .join(F.broadcast(names.toDF("pos_b", "b")), "pos_b")
    )
    strength, is_high = F.abs("r"), F.abs("r") >= 0.9
    foremost = Window.partitionBy(F.lit(1)).orderBy(F.desc(strength), "pos_a", "pos_b")
    strong = (
        pairs.where(strength >= 0.7)
        .withColumn("position", F.row_number().over(foremost))
        .where(F.col("position") <= STRONG_PAIRS)
    )
    text = _text(
        "Strong ", _when(F.col("r") > 0, "positively", "negatively"), " correlated pair: '",
        F.col("a"), "' and '", F.col("b"), "' (r = ", fixed(F.col("r"), 2), "). ",
        _when(
            is_high,
            "High multicollinearity — consider dropping one in regression.",
            "Strong linear relationship worth investigating.",
        ),
    )
    both = F.array("a", "b")
    strong_rows = _listed(
        strong,
        F.col("position"),
        [
            _finding(1, is_high, "correlation", "high", text, both),
            _finding(2, ~is_high, "correlation", "medium", text, both),
        ],
    )
    entry = F.struct("pos_a", "pos_b", "a", "b", "r")
    moderate = pairs.where(strength < 0.7).agg(F.sort_array(F.collect_list(entry)).alias("pairs"))
    shown = F.transform(
        F.slice("pairs", 1, MODERATE_PAIRS),
        lambda p: _text("'", p["a"], "'↔'", p["b"], "' (", fixed(p["r"], 2), ")"),
    )
    cols = F.array_sort(F.array_union(F.col("pairs.a"), F.col("pairs.b")))
    moderate_rows = _listed(
        moderate,
        F.lit(0),
        [
            _finding(
                3,
                F.size("pairs") > 0,
                "correlation",
                "low",
                _text("Moderate correlations detected: ", F.array_join(shown, ", "), "."),
                cols,
                part=1,
            )
        ],
    )
    return strong_rows.unionByName(moderate_rows)


def importance_findings(importance: DataFrame) -> DataFrame:
    """Which columns stand out, and which hold little."""

    def labelled(label: str) -> Column:
        entry = F.struct("position", F.col("column").alias("column"))
        return F.sort_array(F.collect_list(F.when(F.col("label") == label, entry)))

    lists = importance.agg(labelled("important").alias("best"), labelled("low").alias("low"))

    def first_five(group: str) -> Column:
        return F.slice(F.transform(group, lambda c: c["column"]), 1, LISTED_COLUMNS)

    more = _when(F.size("low") > LISTED_COLUMNS, "…", "")
    return _listed(
        lists,
        F.lit(0),
        [
            _finding(
                1, F.size("best") > 0, "feature", "medium",
                _text(
                    "Top-ranked columns by information content: ",
                    F.array_join(first_five("best"), ", "),
                    ". These should be prioritised in any analysis or model.",
                ),
                first_five("best"),
            ),
            _finding(
                2, F.size("low") >= 3, "feature", "low",
                _text(
                    F.size("low").cast("string"), " columns scored low on importance: ",
                    F.array_join(first_five("low"), ", "), more,
                    ". Consider dropping them to reduce noise.",
                ),
                first_five("low"),
            ),
        ],
    )

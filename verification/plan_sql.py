"""SQL for importance, chart choice, findings, features and digest over a profile."""

from __future__ import annotations

from verification.datasets import N, Dataset
from verification.profile_sql import profile_sql


def _case(*branches: tuple[str, str], otherwise: str = "0") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {otherwise} END"


def _text(*parts: str) -> str:
    """Concatenation that is NULL if a part is."""
    return " || ".join(parts)


def _pct(expression: str, digits: int = 0) -> str:
    return f"printf('%.{digits}f', CAST({expression} AS DOUBLE))"


PREPARED = """
SELECT *, coalesce(cv_pct, 0) AS cv, abs(coalesce(skewness, 0)) AS askew,
 coalesce(skewness, 0) AS skew, coalesce(kurtosis, 0) AS kurt,
 coalesce(outlier_ratio, 0) AS outl, coalesce(numeric_entropy, 0) AS ent,
 coalesce(n_valid, 0) AS nv, coalesce(normalised_entropy, 0) AS nent,
 coalesce(balance_score, 0) AS bal, coalesce(cardinality_ratio, 0) AS card,
 coalesce(unique_count, 0) AS uniq, coalesce(dominant_rate, 0) AS dom,
 coalesce(regularity_pct, 0) AS reg, coalesce(unique_dates, 0) AS udates,
 coalesce(monotonic, false) AS mono, coalesce(is_discrete, false) AS disc FROM prof"""

# (type or none, [(condition, points, reason or none), ...]) per signal
SIGNALS: list[tuple[str | None, list[tuple[str, str, str | None]]]] = [
    (None, [
        ("missing_rate >= 80", "-4", _text("'Mostly missing ('", _pct("missing_rate"), "'%)'")),
        ("missing_rate >= 50", "-2.5", _text("'High missing rate ('", _pct("missing_rate"), "'%)'")),
        ("missing_rate >= 20", "-1",
         _text("'Notable missing values ('", _pct("missing_rate"), "'%)'")),
        ("missing_rate > 0", "-0.2", None),
    ]),
    ("numeric", [("true", "2", None)]),
    ("numeric", [
        ("cv > 100", "2.5", "'Very high variability (CV > 100%)'"),
        ("cv > 30", "1.5", "'High variability'"),
        ("cv < 1", "-2", "'Near-constant values (low variance)'"),
    ]),
    ("numeric", [
        ("askew > 0.3 AND askew < 2", "0.5", "'Moderately skewed distribution'"),
        ("askew >= 2", "1", "'Highly skewed — potential for transformation'"),
    ]),
    ("numeric", [("abs(kurt) > 3", "0.5", "'Heavy tails (high kurtosis)'")]),
    ("numeric", [("ent > 3.5", "1.5", "'High information content'"), ("ent > 2", "0.5", None)]),
    ("numeric", [
        ("outl > 20", "-1.5", _text("'Very high outlier density ('", _pct("outl", 1), "'%)'")),
        ("outl > 10", "-0.5", _text("'Notable outliers ('", _pct("outl", 1), "'%)'")),
    ]),
    ("numeric", [("mono", "1", "'Monotonic trend — good time-series signal'")]),
    ("numeric", [("nv >= 10000", "0.5", None), ("nv < 10", "-1", "'Very few valid values'")]),
    ("categorical", [("true", "1.5", None)]),
    ("categorical", [
        ("nent >= 0.85", "2", "'Near-uniform distribution (high entropy)'"),
        ("nent >= 0.55", "1", "'Good category diversity'"),
        ("nent < 0.2", "-1.5", "'One dominant category (low entropy)'"),
    ]),
    ("categorical", [("bal > 0.7", "0.5", "'Balanced categories'")]),
    ("categorical", [
        ("card > 0.9", "-3", "'Almost unique values — effectively an ID column'"),
        ("card > 0.5", "-1.5", "'Very high cardinality'"),
        ("uniq = 1", "-3", "'Single value — no variance'"),
        ("uniq = 2", "0.5", "'Binary column — clean split'"),
    ]),
    ("categorical", [
        ("dom > 95 OR dom = 0", "-1",
         _text("'One value covers '", _pct("CASE WHEN dom = 0 THEN 100 ELSE dom END"),
               "'% of rows'")),
    ]),
    ("date", [("true", "3", "'Temporal column — enables time-series analysis'")]),
    ("date", [("udates > 0", "1", "'Chronologically ordered'")]),
    ("date", [("inferred_freq IS NOT NULL", "0.5", _text("'Regular '", "inferred_freq", "' cadence'"))]),
    ("date", [
        ("reg >= 80", "0.5", "'Highly regular intervals'"),
        ("reg < 40", "-0.5", "'Irregular intervals'"),
    ]),
    ("date", [("udates < 3", "-2", "'Too few unique dates'")]),
    ("text", [("true", "-1", "'Free-text column (low analytical value)'")]),
]


def importance_ctes(dataset: Dataset) -> str:
    """WITH list up to ``imp`` (column, position, type, score, label, reasons)."""
    points, reasons = [], []
    for kind, steps in SIGNALS:
        gate = f"type = '{kind}' AND " if kind else ""
        points.append(_case(*[(f"{gate}({c})", p) for c, p, _ in steps]))
        reasons.append(_case(*[(f"{gate}({c})", r or "NULL") for c, _, r in steps], otherwise="NULL"))
    return f"""prof AS ({profile_sql(dataset)}),
p AS ({PREPARED}),
raw AS (SELECT "column", position, type, missing_rate, CAST({' + '.join(points)} AS DOUBLE) AS raw,
 concat_ws(' | ', {', '.join(reasons)}) AS reasons FROM p),
imp AS (SELECT "column", position, type, missing_rate, reasons,
 round((raw - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 10, 2) AS score
 FROM raw, (SELECT min(raw) AS lo, max(raw) AS hi FROM raw)),
imp_labelled AS (SELECT *, CASE WHEN score >= 6 THEN 'important' WHEN score >= 3 THEN 'moderate'
 ELSE 'low' END AS label FROM imp)"""


def importance_sql(dataset: Dataset) -> str:
    return (
        f"WITH {importance_ctes(dataset)}"
        ' SELECT "column", type, score, label, missing_rate, reasons FROM imp_labelled'
    )


def correlations_cte(dataset: Dataset, digits: int) -> str:
    """pairs AS (a, b, i, j, r): every numeric pair, NULL for a constant side."""
    names = dataset.of(N)
    parts = []
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, {dataset.position(a)} AS i,"
                f" {dataset.position(b)} AS j, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b})"
                f" THEN round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), {digits}) END AS r"
                f" FROM {dataset.relation} WHERE {both}"
            )
    return f"pairs AS ({' UNION ALL '.join(parts)})"


UNIVARIATE = f"""CASE
 WHEN type = 'date' THEN 'line' WHEN type = 'text' THEN 'table'
 WHEN type = 'numeric' THEN {_case(
    ("disc AND outl > 5", "'boxplot'"), ("disc", "'histogram'"), ("mono", "'line'"),
    ("outl > 5", "'boxplot'"), otherwise="'histogram'")}
 WHEN uniq <= 6 AND dom >= 40 THEN {_case(
    ("card > 0.5", "'treemap'"), ("bal >= 0.25", "'pie'"), otherwise="'donut'")}
 ELSE {_case(("uniq <= 6", "'lollipop'"), ("uniq <= 15", "'bar'"), ("uniq <= 40", "'lollipop'"),
             otherwise="'treemap'")} END"""


def chart_choice_sql(dataset: Dataset) -> str:
    return (
        f"WITH prof AS ({profile_sql(dataset)}), p AS ({PREPARED})"
        f' SELECT "column", type, {UNIVARIATE} AS chart FROM p'
    )


def _cat_num(groups: str, n: str) -> str:
    """Chart of a category with ``groups`` values and the number with prefix ``n``."""
    share = (
        f"(coalesce({n}.min, 0) >= 0 AND (coalesce({n}.max, 0) <= 1.01 OR (coalesce({n}.max, 0) <= 100"
        f" AND coalesce({n}.max, 0) - coalesce({n}.min, 0) <= 100)))"
    )
    uneven = f"({n}.outl > 5 OR {n}.cv > 50)"
    return _case(
        (f"{groups} <= 6 AND {share}", f"CASE WHEN {n}.nv >= 50 THEN 'violin' ELSE 'grouped_bar' END"),
        (f"{groups} <= 5", "'violin'"),
        (f"{groups} <= 6 AND ({uneven} OR {n}.askew > 1)", "'boxplot'"),
        (f"{groups} <= 6", "'grouped_bar'"),
        (f"{groups} <= 15 AND NOT {uneven}", "'grouped_bar'"),
        otherwise="'boxplot'",
    )


def pair_choice_sql(dataset: Dataset) -> str:
    num_num = "x.type = 'numeric' AND y.type = 'numeric'"
    keep = _case(
        ("x.type = 'text' OR y.type = 'text'", "false"),
        ("x.type = 'date' AND y.type = 'date'", "false"),
        ("x.type = 'date' OR y.type = 'date'", "true"),
        (f"{num_num} AND r IS NOT NULL AND abs(r) < 0.15", "false"),
        (num_num, "true"),
        ("x.role = 'categorical' AND y.role = 'numeric'", "x.uniq >= 2"),
        ("y.role = 'categorical' AND x.role = 'numeric'", "y.uniq >= 2"),
        ("x.card > 0.8 OR y.card > 0.8", "false"),
        ("x.uniq > 40 AND y.uniq > 40", "false"),
        otherwise="true",
    )
    chart = _case(
        ("x.type = 'date'", "CASE WHEN y.cv > 50 THEN 'area' ELSE 'line' END"),
        ("y.type = 'date'", "CASE WHEN x.cv > 50 THEN 'area' ELSE 'line' END"),
        (f"{num_num} AND (x.mono OR y.mono)", "'line'"),
        (num_num, "'scatter'"),
        ("x.role = 'categorical' AND y.role = 'numeric'", _cat_num("x.groups", "y")),
        ("y.role = 'categorical' AND x.role = 'numeric'", _cat_num("y.groups", "x")),
        ("x.role = 'categorical' AND y.role = 'categorical'", _case(
            ("greatest(x.groups, y.groups) <= 2", "'grouped_bar'"),
            ("greatest(x.groups, y.groups) <= 15", "'stacked_bar'"), otherwise="'heatmap'")),
        otherwise="'skip'",
    )
    return f"""WITH prof AS ({profile_sql(dataset)}), p0 AS ({PREPARED}),
p AS (SELECT *, CASE WHEN type = 'numeric' AND disc THEN 'categorical' ELSE type END AS role,
 CASE WHEN type = 'numeric' AND disc THEN n_unique_vals ELSE uniq END AS groups FROM p0),
{correlations_cte(dataset, 4)},
c AS (SELECT x."column" AS col_x, y."column" AS col_y, pairs.r, CAST({keep} AS INTEGER) AS keep,
 {chart} AS chart FROM p x JOIN p y ON x.position < y.position
 LEFT JOIN pairs ON pairs.a = x."column" AND pairs.b = y."column")
SELECT col_x, col_y, keep, chart FROM c"""


def insights_sql(dataset: Dataset) -> str:
    """The 40 foremost findings; ``part``, ``position`` and ``rule`` give the order of rules."""
    name = "'''' || \"column\" || ''''"

    def per_column(rule, part, when, category, severity, *parts):
        return (
            f"SELECT {part} AS part, position, {rule} AS rule, '{category}' AS category,"
            f" '{severity}' AS severity, {_text(*parts)} AS text, \"column\" AS cols FROM p WHERE {when}"
        )

    def listed(rule, when, category, severity, entry, *parts, having="count(*) > 0"):
        joined = f"string_agg({entry}, ', ' ORDER BY position)"
        text = _text(*[joined if x == "LIST" else x for x in parts])
        return (
            f"SELECT 0 AS part, 0 AS position, {rule} AS rule, '{category}' AS category,"
            f" '{severity}' AS severity, {text} AS text,"
            f" string_agg(\"column\", ',' ORDER BY position) AS cols FROM p WHERE {when} HAVING {having}"
        )

    rate = '"column" || \' (\' || ' + _pct("missing_rate") + " || '%)'"
    n = "CAST(count(*) AS VARCHAR)"
    quality, dist, cat, num = "data_quality", "distribution", "categorical", "type = 'numeric'"
    outlier_rows = "CAST(CAST(coalesce(outliers_iqr, 0) AS BIGINT) AS VARCHAR)"
    uniques = "CAST(CAST(uniq AS BIGINT) AS VARCHAR)"
    days = "CAST(CAST(coalesce(range_days, 0) AS BIGINT) AS VARCHAR)"
    is_cat, is_date = "type = 'categorical'", "type = 'date'"
    rules = [
        listed(1, "missing_rate >= 50", quality, "high", rate, n,
               "' column(s) have >50% missing values: '", "LIST",
               "'. Consider dropping or imputing them before modelling.'"),
        listed(2, "missing_rate >= 20 AND missing_rate < 50", quality, "medium", rate, n,
               "' column(s) have notable missing data: '", "LIST", "'.'"),
        listed(3, f"{num} AND cv < 0.5 AND nv > 5", quality, "high", '"column"', "'Column(s) '", "LIST",
               "' appear near-constant (CV < 0.5%). They carry almost no signal for analysis or"
               " modelling.'"),
        listed(4, f"{is_cat} AND card > 0.9", quality, "medium", '"column"', "'Column(s) '", "LIST",
               "' look like identifier fields (almost every value is unique). They should be excluded"
               " from statistical analysis.'"),
        per_column(1, 0, f"{num} AND askew >= 2", dist, "high", name, "' is heavily '",
                   "CASE WHEN skew > 0 THEN 'right (positively)' ELSE 'left (negatively)' END",
                   "' skewed (skewness = '", _pct("skew", 2),
                   "'). A log or square-root transformation may improve model performance.'"),
        per_column(2, 0, f"{num} AND askew >= 1 AND askew < 2", dist, "medium", name,
                   "' shows moderate '", "CASE WHEN skew > 0 THEN 'right' ELSE 'left' END",
                   "' skew ('", _pct("skew", 2), "').'"),
        per_column(3, 0, f"{num} AND outl >= 15", dist, "high", name,
                   "' has a very high outlier rate: '", _pct("outl", 1), "'% of values ('",
                   outlier_rows, "' rows) fall outside the IQR fence. Investigate before modelling.'"),
        per_column(4, 0, f"{num} AND outl >= 5 AND outl < 15", dist, "medium", name,
                   "' contains notable outliers ('", _pct("outl", 1), "'%, '", outlier_rows,
                   "' rows).'"),
        per_column(5, 0, f"{num} AND kurt > 5", dist, "medium", name,
                   "' has very heavy tails (excess kurtosis = '", _pct("kurt", 2),
                   "'). Extreme values are much more common than a normal distribution would predict.'"),
        per_column(6, 0, f"{num} AND cv > 100", dist, "medium", name,
                   "' has extremely high relative variability (CV = '", _pct("cv"),
                   "'%). The spread is larger than the mean — check for mixed populations.'"),
        per_column(1, 0, f"{is_cat} AND dom >= 90", cat, "high", name,
                   "' is dominated by one value: '''", "dominant_value", "''' accounts for '",
                   _pct("dom"), "'% of all rows. The column has very little discriminating power.'"),
        per_column(2, 0, f"{is_cat} AND dom >= 70 AND dom < 90", cat, "medium", name,
                   "' is skewed — '''", "dominant_value", "''' covers '", _pct("dom"), "'% of rows.'"),
        per_column(3, 0, f"{is_cat} AND uniq = 2", cat, "low", name, "' is binary with values ['''",
                   "replace(top_values, '|', ''', ''')",
                   "''']. It can be directly used as a feature or target variable.'"),
        per_column(4, 0, f"{is_cat} AND card > 0.5 AND card <= 0.9", cat, "medium", name,
                   "' has high cardinality ('", uniques, "' unique values, '", _pct("card * 100"),
                   "'% of rows). Consider grouping rare categories.'"),
        per_column(1, 0, f"{is_date} AND inferred_freq IS NOT NULL", "trend", "medium", name,
                   "' appears to follow a '", "inferred_freq", "' cadence spanning '", days,
                   "' days. Time-series analysis is applicable.'"),
        per_column(2, 0, f"{is_date} AND regularity_pct < 50", "trend", "medium", name,
                   "' has irregular intervals (only '", _pct("regularity_pct"),
                   "'% of gaps are regular). Resampling may be needed before time-series modelling.'"),
        per_column(3, 1, f"{num} AND monotonic_inc", "trend", "low", name,
                   "' is strictly increasing across the dataset — possibly a cumulative metric or"
                   " time-indexed counter.'"),
        per_column(4, 1, f"{num} AND monotonic_dec AND NOT monotonic_inc", "trend", "low", name,
                   "' is strictly decreasing — check if it represents a declining measure.'"),
    ]
    strong = (
        "SELECT 0 AS part, o AS position, 1 AS rule, 'correlation' AS category,"
        " CASE WHEN abs(r) >= 0.9 THEN 'high' ELSE 'medium' END AS severity, "
        + _text(
            "'Strong '", "CASE WHEN r > 0 THEN 'positively' ELSE 'negatively' END",
            "' correlated pair: '''", "a", "''' and '''", "b", "''' (r = '", _pct("r", 2), "'). '",
            "CASE WHEN abs(r) >= 0.9 THEN 'High multicollinearity — consider dropping one in"
            " regression.' ELSE 'Strong linear relationship worth investigating.' END",
        )
        + " AS text, a || ',' || b AS cols FROM (SELECT *, row_number() OVER"
        " (ORDER BY abs(r) DESC, i, j) AS o FROM pairs WHERE abs(r) >= 0.7) WHERE o <= 5"
    )
    entry = _text("''''", "a", "'''↔'''", "b", "''' ('", _pct("r", 2), "')'")
    moderate = (
        "SELECT 1 AS part, 0 AS position, 3 AS rule, 'correlation' AS category, 'low' AS severity,"
        " 'Moderate correlations detected: ' || (SELECT string_agg(e, ', ' ORDER BY i, j) FROM"
        f" (SELECT {entry} AS e, i, j FROM m ORDER BY i, j LIMIT 4)) || '.' AS text,"
        " (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT a AS c FROM m UNION SELECT b FROM m))"
        " AS cols FROM m HAVING count(*) > 0"
    )
    five = (
        "(SELECT string_agg(\"column\", '{sep}' ORDER BY position) FROM (SELECT \"column\", position"
        " FROM imp_labelled WHERE label = '{label}' ORDER BY position LIMIT 5))"
    )
    best = (
        "SELECT 0 AS part, 0 AS position, 1 AS rule, 'feature' AS category, 'medium' AS severity,"
        " 'Top-ranked columns by information content: ' || "
        + five.format(sep=", ", label="important")
        + " || '. These should be prioritised in any analysis or model.' AS text, "
        + five.format(sep=",", label="important")
        + " AS cols FROM imp_labelled WHERE label = 'important' HAVING count(*) > 0"
    )
    low = (
        f"SELECT 0 AS part, 0 AS position, 2 AS rule, 'feature' AS category, 'low' AS severity, {n}"
        " || ' columns scored low on importance: ' || "
        + five.format(sep=", ", label="low")
        + " || CASE WHEN count(*) > 5 THEN '…' ELSE '' END"
        " || '. Consider dropping them to reduce noise.' AS text, "
        + five.format(sep=",", label="low")
        + " AS cols FROM imp_labelled WHERE label = 'low' HAVING count(*) >= 3"
    )
    found = " UNION ALL BY NAME ".join([*rules, strong, moderate, best, low])
    return f"""WITH {importance_ctes(dataset)},
{correlations_cte(dataset, 3)},
m AS (SELECT * FROM pairs WHERE abs(r) >= 0.4 AND abs(r) < 0.7),
found AS ({found}),
ranked AS (SELECT text, category, severity, cols, row_number() OVER (ORDER BY
 CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, category, part, position, rule)
 AS rank FROM found)
SELECT CAST(rank AS INTEGER) AS rank, text, category, severity, cols FROM ranked WHERE rank <= 40"""


def digest_sql(dataset: Dataset, name: str) -> str:
    def shown(metric: str) -> str:
        return f"coalesce(CAST(CAST({metric} AS DOUBLE) + 0.0 AS VARCHAR), 'None')"

    numeric = _text(
        "': mean='", shown("mean"), "', std='", shown("std"), "', skew='", shown("skewness"),
        "', outlier%='", shown("outlier_ratio"), "', missing%='", shown("missing_rate"),
    )
    categorical = _text(
        "': '", "CAST(CAST(unique_count AS BIGINT) AS VARCHAR)", "' unique, top='''", "dominant_value",
        "''' ('", shown("dominant_rate"), "'%), entropy='", shown("categorical_entropy"),
    )
    dates = _text("': '", "min_date", "' → '", "max_date", "', freq='", "inferred_freq")
    return f"""WITH {importance_ctes(dataset)}
SELECT 'Dataset: {name}, ' || CAST(CAST(max(total) AS BIGINT) AS VARCHAR) || ' rows, ' || count(*)
 || ' columns' || chr(10) || chr(10) || string_agg('  ' || prof."column" || ' [' || prof.type
 || ', importance=' || label || ']' || CASE prof.type WHEN 'numeric' THEN {numeric}
 WHEN 'categorical' THEN {categorical} WHEN 'date' THEN {dates} ELSE '' END, chr(10)
 ORDER BY prof.position) AS digest
FROM prof JOIN (SELECT "column" AS name, label FROM imp_labelled) ON prof."column" = name"""


def feature_catalogue_sql(dataset: Dataset) -> str:
    """Suggested features without ratios, which depend on column names."""
    slug = "substr(trim(lower(regexp_replace(\"column\", '[^a-zA-Z0-9]+', '_', 'g')), '_'), 1, 30)"

    def rule(block, order, when, feature, transform, *reason):
        return (
            f"SELECT {block} AS block, position, {order} AS o, {feature} AS name, '{transform}' AS"
            f' transform, "column" AS source, {_text(*reason)} AS reason FROM p WHERE {when}'
        )

    name = "'''' || \"column\" || ''''"
    num = "type = 'numeric'"
    edges = "min < q1 AND q1 < median AND median < q3 AND q3 < max"
    rules = [
        rule(0, 0, f"{num} AND skew >= 1 AND coalesce(min, 0) >= 0", f"'log1p_' || {slug}", "log1p", name,
             "' is right-skewed (skewness='", _pct("skew", 2), "'); log1p compresses the tail.'"),
        rule(0, 0, f"{num} AND skew >= 0.5 AND skew < 1 AND coalesce(min, 0) >= 0",
             f"'sqrt_' || {slug}", "sqrt", name, "' has moderate right skew ('", _pct("skew", 2),
             "'); square-root softens it.'"),
        rule(0, 1, f"{num} AND cv > 50 AND nv > 5", f"'zscore_' || {slug}", "z_score", name,
             "' has high variability (CV='", _pct("cv"),
             "'%); z-score standardises it for fair comparison.'"),
        rule(0, 2, f"{num} AND nv >= 20 AND {edges}", f"'bin_' || {slug}", "quartile_bin", name,
             "' binned into quartiles — useful for segmentation analysis.'"),
        rule(1, 0, "type = 'date'", f"{slug} || '_year'", "extract_year", "'Year extracted from '",
             name, "' — enables year-over-year comparison.'"),
        rule(1, 1, "type = 'date'", f"{slug} || '_month'", "extract_month",
             "'Month (1–12) extracted from '", name, "' — useful for seasonality analysis.'"),
        rule(1, 2, "type = 'date'", f"{slug} || '_dayofweek'", "extract_dayofweek",
             "'Day of week (0=Mon … 6=Sun) from '", name, "' — detects weekly patterns.'"),
        rule(1, 3, "type = 'date'", f"{slug} || '_quarter'", "extract_quarter",
             "'Quarter (1–4) from '", name, "' — enables quarterly trend analysis.'"),
        rule(1, 4, "type = 'date'", f"{slug} || '_is_weekend'", "is_weekend",
             "'Weekend flag (1/0) from '", name, "' — useful for behaviour segmentation.'"),
        rule(2, 0, "type = 'categorical' AND uniq >= 3", f"'freq_' || {slug}", "frequency_encode",
             "'Frequency encoding of '", name, "' — replaces each category with its row count. '",
             "CASE WHEN card > 0.3 THEN 'Recommended for high-cardinality column.'"
             " ELSE 'Useful as a numeric proxy.' END"),
    ]
    return f"""WITH prof AS ({profile_sql(dataset)}), p AS ({PREPARED}),
f AS ({' UNION ALL '.join(rules)}),
r AS (SELECT *, row_number() OVER (ORDER BY block, position, o) - 1 AS seq FROM f)
SELECT CAST(seq AS INTEGER) AS seq, name, transform, source, reason FROM r WHERE seq < 20"""

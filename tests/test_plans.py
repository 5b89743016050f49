"""Threshold edges of scores, choices and findings, on profile rows typed by hand."""

import pytest

from tabulens.operators.correlation import correlation_pairs  # noqa: F401
from tabulens.plans.choose import choose_charts, choose_pair_charts
from tabulens.plans.importance import score_columns
from tabulens.plans.insights import find_insights
from tabulens.plans.profile import RAW_SCHEMA, profile_frame
from tabulens.session import small_table

NAMES = [field.split()[0] for field in RAW_SCHEMA.split(", ")]


def prof(spark, *rows):
    """Profile rows; final metrics can be given by name and replace the computed ones."""
    metrics, final = [], []
    for i, row in enumerate(rows):
        base = {"column": f"c{i}", "position": i, "total": 1000, "missing": 0, **row}
        metrics.append({k: v for k, v in base.items() if k in NAMES})
        final.append({k: v for k, v in base.items() if k not in NAMES})
    frame = profile_frame(spark, metrics)
    overrides = sorted({name for row in final for name in row})
    if not overrides:
        return frame
    schema = "position int, " + ", ".join(f"_{n} {dict(frame.dtypes)[n]}" for n in overrides)
    values = small_table(spark, [(i, *[r.get(n) for n in overrides]) for i, r in enumerate(final)], schema)
    joined = frame.join(values, "position")
    return joined.select(
        *[joined[f"_{n}"].alias(n) if n in overrides else n for n in frame.columns]
    )


def numeric(**metrics):
    return {"type": "numeric", "mean": 10.0, "std": 4.0, "n_valid": 1000, "n_unique_vals": 900,
            "monotonic_inc": False, "monotonic_dec": False, "all_integers": False, **metrics}


def category(**metrics):
    return {"type": "categorical", "n_valid": 1000, "unique_count": 5, "normalised_entropy": 0.4,
            "balance_score": 0.4, "cardinality_ratio": 0.005, "dominant_rate": 30.0, **metrics}


TEXT = {"type": "text", "n_valid": 1000}


def raw_points(spark, *rows):
    """Score differences to a plain text column, undoing the scaling to 0-10."""
    low = {"type": "text", "missing": 1000}
    high = numeric(mean=1.0, std=9.0, skewness=3.0, kurtosis=9.0, numeric_entropy=4.0, monotonic_inc=True,
                   n_valid=10_000, total=10_000)
    scored = score_columns(prof(spark, *rows, low, high)).orderBy("position").collect()
    # text with everything missing scores -5, the best numeric column 2+2.5+1+.5+1.5+1+.5 = 9
    return [pytest.approx(r["score"] / 10 * 14 - 5, abs=0.01) for r in scored[: len(rows)]], scored


def test_numeric_points(spark):
    rows = [
        numeric(),  # 2 + 1.5 (CV 40)
        numeric(mean=0.0),  # no CV counts as near-constant
        numeric(std=3.0),  # CV 30 is not above 30
        numeric(skewness=0.3),
        numeric(skewness=-0.31),
        numeric(skewness=2.0, kurtosis=3.0),
        numeric(kurtosis=-3.1),
        numeric(numeric_entropy=2.0),
        numeric(numeric_entropy=3.5),
        numeric(numeric_entropy=3.51),
        numeric(outliers_iqr=100),
        numeric(outliers_iqr=101),
        numeric(outliers_iqr=201),
        numeric(monotonic_dec=True),
        numeric(n_valid=9),
        numeric(missing=200),
        numeric(missing=1),
    ]
    points, scored = raw_points(spark, *rows)
    want = [3.5, 0.0, 2.0, 3.5, 4.0, 4.5, 4.0, 3.5, 4.0, 5.0, 3.5, 3.0, 2.0, 4.5, 2.5, 2.5, 3.3]
    assert want == points
    assert scored[1]["reasons"] == ["Near-constant values (low variance)"]
    assert "Notable outliers (10.1%)" in scored[11]["reasons"]
    assert "Notable missing values (20%)" in scored[15]["reasons"]
    assert scored[-1]["label"] == "important" and scored[-1]["score"] == 10


def test_category_points(spark):
    rows = [
        category(),
        category(normalised_entropy=0.85),
        category(normalised_entropy=0.55),
        category(normalised_entropy=0.19),
        category(balance_score=0.71),
        category(cardinality_ratio=0.91),
        category(cardinality_ratio=0.51),
        category(unique_count=1),
        category(unique_count=2),
        category(dominant_rate=95.5),
        category(dominant_rate=None),
        {"type": "text"},
    ]
    points, scored = raw_points(spark, *rows)
    assert [1.5, 3.5, 2.5, 0.0, 2.0, -1.5, 0.0, -1.5, 2.0, 0.5, 0.5, -1.0] == points
    assert scored[10]["reasons"] == ["One value covers 100% of rows"]


def test_date_points(spark):
    base = {"type": "date", "unique_dates": 30, "median_gap_days": 1.0, "regularity_pct": 80.0}
    rows = [
        base,
        {**base, "regularity_pct": 79.9},
        {**base, "regularity_pct": 39.9},
        {**base, "regularity_pct": None},
        {**base, "unique_dates": 2},
        {**base, "median_gap_days": None},
    ]
    points, scored = raw_points(spark, *rows)
    assert [5.0, 4.5, 4.0, 4.0, 3.0, 4.5] == points
    assert "Regular daily cadence" in scored[0]["reasons"]


def test_equal_scores_are_all_zero(spark):
    scored = score_columns(prof(spark, TEXT, TEXT)).collect()
    assert [(r["score"], r["label"]) for r in scored] == [(0, "low"), (0, "low")]


def charts(spark, *rows, intent=None):
    return [r["chart"] for r in choose_charts(prof(spark, *rows), intent).orderBy("position").collect()]


def test_single_column_charts(spark):
    discrete = numeric(all_integers=True, n_unique_vals=5)
    rows = [
        numeric(), numeric(outliers_iqr=51), numeric(monotonic_inc=True), discrete,
        {**discrete, "outliers_iqr": 60}, category(), category(unique_count=7), category(unique_count=15),
        category(unique_count=16), category(unique_count=40), category(unique_count=41),
        category(dominant_rate=40.0), category(dominant_rate=80.0, balance_score=0.2),
        category(dominant_rate=80.0, cardinality_ratio=0.6), {"type": "date"}, TEXT,
    ]
    assert charts(spark, *rows) == [
        "histogram", "boxplot", "line", "histogram", "boxplot", "lollipop", "bar", "bar", "lollipop",
        "lollipop", "treemap", "pie", "donut", "treemap", "line", "table",
    ]


def test_charts_for_an_intent(spark):
    rows = [numeric(outliers_iqr=60), category(), category(unique_count=16)]
    assert charts(spark, *rows, intent="trend") == ["line", "line", "line"]
    assert charts(spark, *rows, intent="ranking") == ["histogram", "lollipop", "lollipop"]
    assert charts(spark, *rows, intent="comparison") == ["boxplot", "bar", "treemap"]
    assert charts(spark, *rows, intent="composition") == ["boxplot", "pie", "treemap"]


def pair(spark, x, y, r=None, intent=None):
    correlations = None
    if r is not None:
        correlations = small_table(spark, [(0, 1, r)], "pos_a int, pos_b int, r double")
    row = choose_pair_charts(prof(spark, x, y), correlations, intent).first()
    return row["keep"], row["chart"], row["built"]


def test_pair_charts(spark):
    discrete = numeric(all_integers=True, n_unique_vals=5)
    wide = numeric(std=6.0, min=0.0, max=900.0)
    calm = numeric(std=1.0, min=0.0, max=900.0)
    date = {"type": "date", "unique_dates": 5}
    assert pair(spark, TEXT, numeric())[:2] == (False, "skip")
    assert pair(spark, date, date)[0] is False
    assert pair(spark, date, wide) == (True, "area", "area")
    assert pair(spark, calm, date) == (True, "line", "line")
    assert pair(spark, numeric(), numeric(), 0.1499) == (False, "scatter", "scatter")
    assert pair(spark, numeric(), numeric(), -0.15) == (True, "scatter", "scatter")
    assert pair(spark, numeric(), numeric())[0] is True
    assert pair(spark, numeric(), numeric(monotonic_inc=True), 0.5)[1:] == ("line", "line")
    # a discrete number next to a number is chosen as points but built from groups
    assert pair(spark, discrete, numeric(), 0.5) == (True, "scatter", "bar")
    assert pair(spark, discrete, discrete, 0.5) == (True, "scatter", "stacked_bar")
    assert pair(spark, category(), calm)[1:] == ("violin", "violin")
    assert pair(spark, calm, category(unique_count=6))[1:] == ("grouped_bar", "bar")
    assert pair(spark, category(unique_count=6), wide)[1] == "boxplot"
    assert pair(spark, category(unique_count=6), numeric(std=1.0, max=900.0, skewness=1.1))[1] == "boxplot"
    assert pair(spark, category(unique_count=15), calm)[1] == "grouped_bar"
    assert pair(spark, category(unique_count=16), calm)[1] == "boxplot"
    share = numeric(min=0.0, max=1.0)
    assert pair(spark, category(unique_count=6), share)[1] == "violin"
    assert pair(spark, category(unique_count=6), {**share, "n_valid": 49})[1] == "grouped_bar"
    assert pair(spark, category(unique_count=1), calm)[0] is False
    two = category(unique_count=2)
    assert pair(spark, two, two)[1:] == ("grouped_bar", "stacked_bar")
    assert pair(spark, category(unique_count=15), two)[1] == "stacked_bar"
    assert pair(spark, category(unique_count=16), two)[1:] == ("heatmap", "heatmap")
    many = category(unique_count=41)
    assert pair(spark, many, many)[0] is False
    assert pair(spark, category(cardinality_ratio=0.81), two)[0] is False
    assert pair(spark, category(), calm, intent="ranking")[1:] == ("lollipop", "lollipop")
    assert pair(spark, numeric(), numeric(), intent="trend")[1] == "line"


def insights(spark, *rows, correlations=None):
    p = prof(spark, *rows)
    pairs = None
    if correlations is not None:
        pairs = small_table(spark, correlations, "pos_a int, pos_b int, r double")
    return find_insights(p, score_columns(p), pairs).orderBy("rank").collect()


def test_findings_are_ranked_and_worded(spark):
    found = insights(
        spark,
        numeric(missing=500),
        numeric(missing=496, skewness=-2.0, outliers_iqr=150, kurtosis=5.01),
        numeric(mean=1000.0, std=1.0),
        category(cardinality_ratio=0.91),
        category(dominant_rate=90.0, dominant_value="q", unique_count=2, top_values=["q", "r"]),
        category(cardinality_ratio=0.9),
        numeric(monotonic_dec=True, std=11.0),
    )
    texts = [r["text"] for r in found]
    assert [r["severity"] for r in found] == sorted(
        [r["severity"] for r in found], key=["high", "medium", "low"].index
    )
    assert any(t.startswith("1 column(s) have >50% missing values: c0 (50%).") for t in texts)
    assert "1 column(s) have notable missing data: c1 (50%)." in texts
    assert any(t.startswith("Column(s) c2 appear near-constant") for t in texts)
    assert any(t.startswith("Column(s) c3 look like identifier fields") for t in texts)
    assert any(t.startswith("'c1' is heavily left (negatively) skewed (skewness = -2.00)") for t in texts)
    assert any(t.startswith("'c1' has a very high outlier rate: 15.0% of values (150 rows)") for t in texts)
    assert any("excess kurtosis = 5.01" in t for t in texts)
    assert any(t.startswith("'c4' is dominated by one value: 'q' accounts for 90%") for t in texts)
    assert any("values ['q', 'r']" in t for t in texts)
    assert any(t.startswith("'c5' has high cardinality (5 unique values, 90% of rows)") for t in texts)
    assert any(t.startswith("'c6' has extremely high relative variability (CV = 110%)") for t in texts)
    assert any(t.startswith("'c6' is strictly decreasing") for t in texts)


def test_correlation_findings(spark):
    rows = [numeric() for _ in range(9)]
    pairs = [(0, 1, 0.95), (0, 2, -0.7), (0, 3, 0.6999), (0, 4, 0.4), (0, 5, -0.5), (0, 6, 0.45), (0, 7, 0.41),
             (0, 8, 0.3994), (1, 2, None), (1, 3, 0.71), (1, 4, 0.72), (1, 5, 0.73), (1, 6, 0.74)]
    found = [r for r in insights(spark, *rows, correlations=pairs) if r["category"] == "correlation"]
    strong = [r for r in found if r["severity"] != "low"]
    assert len(strong) == 5 and strong[0]["severity"] == "high" and strong[0]["cols"] == ["c0", "c1"]
    assert [tuple(r["cols"]) for r in strong[1:]] == [("c1", "c6"), ("c1", "c5"), ("c1", "c4"), ("c1", "c3")]
    assert "negatively" not in "".join(r["text"] for r in strong)  # the 0.7 pair is the sixth
    moderate = [r for r in found if r["severity"] == "low"]
    assert moderate[0]["text"] == (
        "Moderate correlations detected: 'c0'↔'c4' (0.40), 'c0'↔'c5' (-0.50), 'c0'↔'c6' (0.45), "
        "'c0'↔'c7' (0.41)."
    )


def test_at_most_forty_findings(spark):
    rows = [numeric(skewness=3.0, std=11.0, kurtosis=6.0, outliers_iqr=200) for _ in range(20)]
    found = insights(spark, *rows)
    assert len(found) == 40 and all(r["severity"] == "high" for r in found)


def test_importance_findings(spark):
    rows = [TEXT] * 6 + [numeric(), numeric()]
    found = {r["severity"]: r for r in insights(spark, *rows) if r["category"] == "feature"}
    assert found["medium"]["cols"] == ["c6", "c7"]
    assert found["low"]["text"].startswith("6 columns scored low on importance: c0, c1, c2, c3, c4….")
    assert not [r for r in insights(spark, TEXT, TEXT, numeric()) if r["severity"] == "low"]

import datetime as dt

import pytest
from pyspark.sql import functions as F

import tabulens
from tabulens.operators.sampling import SAMPLE_ROWS
from tabulens.plans.features import add_features, suggest_features
from tabulens.plans.profile import column_metrics
from tabulens.plans.types import detect_types

N = 700


@pytest.fixture(scope="module")
def report(spark):
    rows = [
        (
            i, float((i * 37) % N), float((i * 37) % N) * 2 + (i % 5), "abc"[i % 3] if i % 50 else "rare",
            dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 300), i % 4, f"name {i}", i % 2 == 0,
            1.5 if i == 7 else None,
        )
        for i in range(N)
    ]
    schema = "id int, x double, y double, cat string, day timestamp_ntz, level int, name string, yes boolean, lone double"
    return tabulens.full_report(spark.createDataFrame(rows, schema).repartition(5), ["id"])


def test_report_parts(report):
    assert report.quality.first()["rows"] == N
    assert [r["id"] for r in report.preview.collect()] == list(range(10))
    assert report.importance.count() == 9
    text = report.digest("t").first()[0]
    assert text.startswith(f"Dataset: t, {N} rows, 9 columns\n\n  id [numeric, importance=")
    assert "mean=None" in text  # booleans have no metrics


def test_every_chart_has_data(report):
    for key, chart in report.charts.items():
        assert chart.frame.count() > 0, key
        for part in chart.parts:
            chart.part(part).collect()


def test_chosen_charts(report):
    keys = set(report.charts)
    assert {"line_id", "histogram_x", "line_day", "correlation_matrix", "missing_heatmap"} <= keys
    assert "scatter_x__y" in keys and report.charts["scatter_x__y"].correlation > 0.99
    assert not any("name" in key or "yes_" in key for key in keys)
    assert report.charts["scatter_x__y"].frame.count() == SAMPLE_ROWS
    trend = report.charts["scatter_x__y"].part("trendline").first()
    assert trend["slope"] == pytest.approx(2, abs=0.01)
    line = report.charts["line_id"].frame.orderBy("row").collect()
    assert [r["row"] for r in line] == list(range(0, N, N // 200))
    assert report.charts["histogram_level"].frame.count() == 4


def test_single_values_have_a_histogram(report):
    rows = report.charts["histogram_lone"].frame.collect()
    assert len(rows) == 5 and sum(r["n"] for r in rows) == 1


def test_missing_mask(report):
    rows = report.charts["missing_heatmap"].frame.orderBy("_rid").collect()
    assert [r["_rid"] for r in rows] == list(range(0, N, N // 100))
    assert all(r["lone"] == (0 if r["_rid"] == 7 else 1) and r["x"] == 0 for r in rows)


def test_charts_on_request(report):
    wanted = {
        ("x", None): ["histogram", "boxplot", "violin", "line"],
        ("cat", None): ["bar", "lollipop", "pie", "donut", "treemap"],
        ("day", "x"): ["line", "area"],
        ("x", "y"): ["scatter", "line"],
        ("cat", "x"): ["grouped_bar", "bar", "lollipop", "boxplot", "violin", "heatmap"],
        ("x", "cat"): ["grouped_bar", "lollipop", "boxplot", "violin"],
        ("cat", "cat"): [],
    }
    for (x, y), kinds in wanted.items():
        for kind in kinds:
            chart = report.chart(x, y, kind)
            assert chart.frame.count() > 0 and not chart.recommended, (x, y, kind)
    for x, y, kind in (
        ("x", None, "bar"), ("name", None, "bar"), ("yes", None, "histogram"), ("x", "cat", "heatmap"),
        ("cat", "name", "bar"), ("x", "y", "stacked_bar"), ("lone", "x", "scatter"), ("day", "x", "scatter"),
    ):
        with pytest.raises(ValueError):
            report.chart(x, y, kind)
    with pytest.raises(ValueError, match="not found"):
        report.chart("nope", None, "bar")


def test_order_columns_may_have_any_name(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i % 9), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double, `grp.x` string")
    report = tabulens.full_report(df, ["ts", "value", "grp.x"])
    for key, chart in report.charts.items():
        assert chart.frame.count() > 0, key
        for part in chart.parts:
            chart.part(part).collect()
    assert report.preview.count() == 10
    assert report.feature_values.count() == 60


def test_groups_too_small_are_flagged(spark):
    rows = [(g, float(i)) for g, n in (("a", 3), ("b", 4), ("c", 9), ("d", 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    report = tabulens.full_report(df)
    box = {r["grp"]: r["insufficient_data"] for r in report.chart("g", "v", "boxplot").frame.collect()}
    assert box == {"a": True, "b": False, "c": False, "d": False}
    violin = {r["grp"]: r["insufficient_data"] for r in report.chart("g", "v", "violin").frame.collect()}
    assert violin == {"a": True, "b": True, "c": True, "d": False}


def features(df, order_by=()):
    types = detect_types(df, order_by)
    return {f.name: f for f in suggest_features(types, column_metrics(df, order_by, types))}


def test_ratios(spark):
    rows = [(float(i), float(i % 3), 5.0 + i, 1.0 + i, 2.0 + i, -1.0 * i) for i in range(30)]
    df = spark.createDataFrame(
        rows, "Sales double, cost double, visits double, profit double, revenue double, spend double"
    )
    found = features(df)
    ratios = [name for name in found if name.startswith("ratio_")]
    # two matches per side, each pair of columns once, negative columns left out
    assert ratios == [
        "ratio_sales_per_cost", "ratio_profit_per_cost", "ratio_sales_per_visits",
        "ratio_profit_per_sales", "ratio_profit_per_revenue",
    ]
    out = add_features(df, [found["ratio_sales_per_cost"]]).collect()
    for r in out:
        want = None if r["cost"] == 0 else round(r["Sales"] / r["cost"], 6)
        assert r["ratio_sales_per_cost"] == want


def test_no_quartiles_for_few_values_or_equal_edges(spark):
    df = spark.range(40).selectExpr("id", "5.0 AS same", "CASE WHEN id < 30 THEN 1 ELSE id END AS heavy")
    found = features(df, ["id"])
    assert "bin_id" in found and "bin_same" not in found and "bin_heavy" not in found
    assert "bin_id" not in features(df.where("id < 19"), ["id"])


def test_at_most_twenty_features(spark):
    df = spark.range(60).selectExpr(*[f"(id * {i + 3}) % 53 AS c{i}" for i in range(14)])
    found = features(df)
    assert len(found) == 20 and all(name.startswith(("zscore_", "bin_", "sqrt_", "log1p_")) for name in found)


def test_date_features_of_text(spark):
    df = spark.createDataFrame([(f"2024-01-{5 + i:02d}",) for i in range(4)] + [(None,)], "d string")
    out = add_features(df, list(features(df).values())).orderBy("d").collect()
    assert [r["d_is_weekend"] for r in out] == [0, 0, 1, 1, 0]
    assert [r["d_year"] for r in out] == [None, 2024, 2024, 2024, 2024]


def test_names_of_features_do_not_clash(spark):
    rows = [(i, float(i % 13) ** 3 + 1, 0.5, "ab"[i % 2], "x") for i in range(60)]
    df = spark.createDataFrame(
        rows, "id int, price double, log1p_price double, grp string, _value string"
    )
    report = tabulens.full_report(df, order_by=["id"])
    names = report.features.columns
    assert len({n.lower() for n in names}) == len(names)
    assert report.feature_values.count() == 60


def test_frequencies_without_a_broadcast(spark, monkeypatch):
    from tabulens.operators import frequency

    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "_value string")
    for most in (10, 0):
        monkeypatch.setattr(frequency, "BROADCAST_VALUES", most)
        got = frequency.frequency_encode(df, "_value", "n").collect()
        assert sorted((r["_value"] or "", r["n"]) for r in got) == [("", None), ("a", 2), ("a", 2), ("b", 1)]


def test_equal_points_are_drawn_as_often_as_they_occur(spark):
    from tabulens.plans import charts
    from tabulens.plans.types import detect_types

    df = spark.range(3000).selectExpr(
        "IF(id % 3 = 0, 7.5D, id + 0.25D) AS x", "IF(id % 3 = 0, 1.5D, id * 2.0D) AS y"
    )
    x, y = detect_types(df)
    sample = charts.scatter_data(df, x, y)
    assert sample.columns == ["x", "y"]
    drawn = sample.where("x = 7.5").count()
    assert sample.count() == 600 and 150 < drawn < 250


def test_timeline_ignores_the_zone(spark):
    from tabulens.plans import charts
    from tabulens.plans.types import detect_types

    df = spark.sql(
        "SELECT CAST(t AS TIMESTAMP_NTZ) AS t FROM VALUES ('2024-03-10 01:30:00'),"
        " ('2024-03-10 02:30:00'), ('2024-03-10 03:10:00') AS v(t)"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = charts.timeline(df, detect_types(df)[0]).orderBy("point").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [str(r.ts)[11:16] for r in rows] == ["01:30", "02:30", "03:10"]


def test_complete_rows_see_nan_as_a_gap(spark):
    from tabulens.plans import charts
    from tabulens.plans.types import detect_types

    nan = float("nan")
    df = spark.createDataFrame(
        [(1.0, nan, "a"), (nan, 2.0, "b"), (3.0, None, "c"), (4.0, 5.0, None)],
        "x double, y double, c string",
    )
    x, y, c = detect_types(df)
    assert charts._complete_rows(df, [(x, y), (x, c), (y, c)]) == [1, 2, 1]


@pytest.fixture(scope="module")
def many_numbers(spark):
    u = [F.rand(seed) for seed in range(4)]
    return spark.range(0, 20_000, 1, 6).select(
        "id", (u[0] * 9).alias("a"), (F.sqrt(u[1]) + F.col("id") / 9000).alias("b.c"),
        F.when(u[2] < 0.3, u[2] * 50 + F.col("id") / 700).alias("gaps"),
        F.when(F.col("id") % 1009 == 0, u[3]).alias("rare"), F.lit("same").alias("tied"),
    )


@pytest.mark.parametrize("order_by", [["id"], ["tied"], ["tied", "id"], []])
def test_scatters_share_one_sample(many_numbers, order_by):
    """Charts draw from the shared rows what they would draw from the table, or from the table."""
    from tabulens.plans import charts

    by_name = {c.name: c for c in detect_types(many_numbers, order_by)}
    names = [("a", "b.c"), ("a", "gaps"), ("gaps", "b.c"), ("a", "rare")]
    pairs = [(by_name[x], by_name[y]) for x, y in names]
    complete = charts._complete_rows(many_numbers, pairs)
    assert complete[0] == 20_000 and 5500 < complete[1] < 6500 and complete[3] == 20
    sample = charts.SharedSample(
        many_numbers, {k: (*p, n) for k, p, n in zip(names, pairs, complete)}, order_by
    )
    for key, (x, y) in zip(names, pairs):
        got = charts.scatter_data(sample.source(x, y), x, y, order_by).select("x", "y").collect()
        assert len(got) == min(600, complete[names.index(key)])
        if order_by != ["tied"]:  # ties leave open which rows are drawn
            want = charts.scatter_data(many_numbers, x, y, order_by).select("x", "y").collect()
            assert sorted(got) == sorted(want)
    if order_by != ["tied"]:
        assert sample.rows.count() < 16_000 and sample.held == set(names[:3])
    assert sample.source(*pairs[3]) is many_numbers


def test_a_report_draws_once(spark, monkeypatch):
    from tabulens.operators import sampling
    from tabulens.plans import charts

    alike = [(F.rand(i) + F.col("id") / 20_000).alias(f"v{i}") for i in range(3)]
    df = spark.range(0, 20_000, 1, 6).select("id", *alike)
    report = tabulens.full_report(df, order_by=["id"])
    scatters = {k: c for k, c in report.charts.items() if c.built == "scatter"}
    drawn = []
    plain = sampling.smallest_share
    monkeypatch.setattr(charts, "smallest_share", lambda *a: (drawn.append(a), plain(*a))[1])
    scanned = [c.frame._jdf.queryExecution().optimizedPlan().toString() for c in scatters.values()]
    assert len(scatters) > 1 and len(drawn) == 1
    assert all("Range" not in plan for plan in scanned)
    chart = next(iter(scatters.values()))
    assert chart.part("outliers").count() >= 0 and chart.part("trendline").count() == 1
    assert len(drawn) == 1

import datetime as dt

import pytest
from pyspark.sql import functions as F

import tabulens
from tabulens.plans.profile import column_metrics
from tabulens.plans.types import detect_types

N = 100


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i in range(N):
        rows.append((
            i, 5.0, float(i - 50) + 0.5, i % 2 == 0, None if i == 3 else i % 3 == 0,
            f"{1000 + i:,}" if i < 90 else "x", f"{1000 + i:,}" if i < 89 else f"word {i}",
            (dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat(),
            "2024-01-01" if i else "01/02/2024",
            "a" if i < 72 else "b", f"id {i}", ["", "  ", None, "abc"][i % 4], float("nan") if i < 50 else 1.5 * i,
            [i], dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * i), None,
        ))
    schema = (
        "rid int, const double, centred double, yes boolean, maybe boolean, commas string,"
        " few_numbers string, iso string, mixed string, cat string, name string, blanks string,"
        " gaps double, nested array<int>, weekly timestamp_ntz, empty string"
    )
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.fixture(scope="module")
def types(table):
    return {c.name: c for c in detect_types(table, ["rid"])}


@pytest.fixture(scope="module")
def rows(table):
    return {r["column"]: r for r in tabulens.profile(table, ["rid"]).collect()}


def test_types(types):
    want = {
        "rid": "numeric", "const": "numeric", "centred": "numeric", "yes": "numeric",
        "maybe": "categorical", "commas": "numeric", "few_numbers": "text", "iso": "date",
        "mixed": "categorical", "cat": "categorical", "name": "text", "blanks": "categorical",
        "gaps": "numeric", "nested": "nested", "weekly": "date", "empty": "text",
    }
    assert {name: c.kind for name, c in types.items()} == want
    assert types["iso"].date_format == "yyyy-M-d"


def test_constant_column(rows):
    r = rows["const"]
    assert (r["skewness"], r["skew_type"], r["distribution"]) == (None, "symmetric", "highly_skewed")
    assert (r["numeric_entropy"], r["cv_pct"], r["outliers_iqr"], r["is_normal_like"]) == (0, 0, 0, False)
    assert r["monotonic_inc"] and r["monotonic_dec"] and r["is_discrete"]


def test_mean_of_zero_has_no_variation_coefficient(rows):
    r = rows["centred"]
    assert (r["mean"], r["cv_pct"], r["variance_score"], r["negative_count"]) == (0, None, None, 50)


def test_booleans_have_base_metrics_only(rows):
    assert rows["yes"]["mean"] is None and rows["yes"]["missing"] == 0
    assert rows["maybe"]["top_values"] == ["False", "True"] and rows["maybe"]["missing"] == 1


def test_numbers_written_as_text(rows):
    r = rows["commas"]
    assert (r["n_valid"], r["min"], r["max"], r["missing"]) == (90, 1000, 1089, 0)
    assert r["monotonic_inc"]


def test_nan_is_missing(rows):
    r = rows["gaps"]
    assert (r["missing"], r["missing_rate"], r["n_valid"], r["min"]) == (50, 50, 50, 75)


def test_dates(rows):
    r = rows["iso"]
    assert (r["min_date"], r["max_date"], r["range_days"]) == ("2024-01-01", "2024-04-09", 99)
    assert (r["inferred_freq"], r["regularity_pct"], r["unique_dates"], r["is_sorted"]) == (
        "daily", 100, 100, True,
    )
    assert rows["weekly"]["inferred_freq"] == "weekly"
    assert rows["weekly"]["input_is_sorted"] and rows["iso"]["input_is_sorted"]
    assert rows["rid"]["input_is_sorted"] is None


def test_dates_that_are_not_in_the_order_of_the_rows(table):
    backwards = table.withColumn("k", -F.col("rid"))
    found = {r["column"]: r for r in tabulens.profile(backwards.select("k", "weekly"), ["k"]).collect()}
    assert (found["weekly"]["is_sorted"], found["weekly"]["input_is_sorted"]) == (True, False)


def test_categories_and_texts(rows):
    assert (rows["cat"]["dominant_value"], rows["cat"]["dominant_rate"]) == ("a", 72)
    assert rows["cat"]["top_counts"] == [72, 28] and rows["cat"]["top_pcts"] == [72.0, 28.0]
    assert (rows["name"]["unique_count"], rows["name"]["min_length"], rows["name"]["max_length"]) == (100, 4, 5)
    assert rows["nested"]["missing"] == 0 and rows["empty"]["missing_rate"] == 100
    assert rows["empty"]["n_valid"] is None


def test_blank_texts(spark):
    values = ["", "  ", None, "abc", "de", "fghi"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    r = tabulens.profile(df).first()
    assert (r["type"], r["blank_count"], r["blank_rate"], r["median_length"]) == ("text", 2, 40, 2)


def test_quality(spark, rows, table):
    q = tabulens.quality_summary(tabulens.profile(table, ["rid"])).first()
    missing = sum(r["missing"] for r in rows.values())
    assert (q["rows"], q["columns"], q["total_missing_cells"]) == (N, 16, missing)
    assert q["overall_missing_pct"] == round(missing / (N * 16) * 100, 2)


def test_narrowing_gives_the_same_metrics(table):
    names = ["rid", "const", "centred", "commas", "gaps"]
    df = table.select(*names)
    plain = column_metrics(df, ["rid"])
    narrowed = column_metrics(df, ["rid"], direct_rows=7)
    for a, b in zip(plain, narrowed):
        assert a.keys() == b.keys()
        for name in a:
            assert a[name] == (pytest.approx(b[name]) if isinstance(a[name], float) else b[name])


def test_profile_does_not_depend_on_partitions(table):
    names = ["rid", "gaps", "cat", "iso"]
    one = tabulens.profile(table.select(*names).coalesce(1), ["rid"]).collect()
    many = tabulens.profile(table.select(*names).repartition(9), ["rid"]).collect()
    for a, b in zip(one, many):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y) if isinstance(x, float) else y)


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "`a.b` int, `c ``d` string")
    rows = tabulens.profile(df).collect()
    assert [r["column"] for r in rows] == ["a.b", "c `d"] and rows[0]["mean"] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = tabulens.profile(df).collect()
    assert [r["type"] for r in rows] == ["text", "text"] and rows[0]["missing_rate"] == 0
    with pytest.raises(ValueError):
        tabulens.full_report(df)


def test_small_decimals_and_floats(spark):
    df = spark.range(4).select(
        F.col("id").cast("decimal(10,2)").alias("d"), (F.col("id") * 0.1).cast("float").alias("f")
    )
    found = {r["column"]: r for r in tabulens.profile(df).collect()}
    assert found["d"]["mean"] == 1.5 and found["f"]["max"] == 0.3

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tabulens.operators import groups
from tabulens.operators.bins import bin_count, histogram, spread_metrics
from tabulens.operators.correlation import correlation_pairs, line_fit
from tabulens.operators.density import density
from tabulens.operators.frequency import (
    category_metrics,
    distinct_counts,
    frequency_encode,
    mode_metrics,
    text_key,
    to_long,
    value_counts,
)
from tabulens.operators.gaps import date_spans, gap_metrics
from tabulens.operators.moments import moments
from tabulens.operators.ordinal import (
    every_nth,
    in_order,
    is_row_number,
    join_runs,
    monotonic_flags,
    monotonic_runs,
    order_words,
    with_ordinal,
)
from tabulens.operators.quantiles import (
    Bracket,
    _thinned,
    column_cells,
    column_quantiles,
    exact_quantiles,
)
from tabulens.operators.sampling import sample_rows, scatter_outliers


def long_frame(spark, columns):
    rows = [(pos, float(v)) for pos, values in columns.items() for v in values if v is not None]
    return spark.createDataFrame(rows, "pos int, value double").repartition(3)


def by_pos(frame):
    return {row["pos"]: row for row in frame.collect()}


def test_moments(spark):
    found = by_pos(moments(long_frame(spark, {0: [1, 2, 3, 9], 1: [5.0] * 20, 2: [-1, 0, 0.5]})))
    first = found[0]
    assert (first["n_valid"], first["mean"], first["min"], first["max"]) == (4, 3.75, 1, 9)
    assert first["skewness"] == pytest.approx(0.97941, abs=1e-5)
    assert first["kurtosis"] == pytest.approx(-0.79809, abs=1e-5)
    assert first["std"] == pytest.approx(3.59398, abs=1e-5)
    assert found[1]["skewness"] is None and found[1]["std"] == 0
    assert (found[2]["zero_count"], found[2]["negative_count"]) == (1, 1)
    assert first["all_integers"] and not found[2]["all_integers"]


def test_mode_is_smallest_of_the_most_frequent(spark):
    long = long_frame(spark, {0: [3, 1, 3, 1], 1: [1, 2, 3], 2: [7, 7, 8]})
    found = by_pos(value_counts(long, "pos", "value").groupBy("pos").agg(*mode_metrics()))
    assert [found[i]["mode"] for i in range(3)] == [1.0, None, 7.0]
    assert [found[i]["n_unique_vals"] for i in range(3)] == [2, 3, 2]


QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


@pytest.mark.parametrize("direct_rows", [10**6, 60, 7])
def test_quantiles_match_linear_interpolation(spark, direct_rows):
    rng = random.Random(5)
    columns = {
        0: [rng.gauss(0, 1) for _ in range(900)],
        1: [rng.choice([1.0, 2.0, 2.0, 2.0, 9.0]) for _ in range(700)],  # hot values
        2: [4.0] * 300,
        3: [10.0 ** rng.randint(-8, 8) * rng.random() for _ in range(500)],
        4: [0.5],
        5: [5.0] * 400 + [rng.random() for _ in range(80)],
    }
    sizes = {pos: len(values) for pos, values in columns.items()}
    found = by_pos(exact_quantiles(long_frame(spark, columns), QUANTILES, sizes, direct_rows))
    for pos, values in columns.items():
        assert found[pos]["q"] == pytest.approx(list(np.quantile(values, QUANTILES)), rel=1e-12)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from([0.0, 1.0, -3.5, 2.25, 1e9]) | st.floats(-1e6, 1e6), min_size=30, max_size=90))
def test_narrowed_quantiles_on_any_values(spark, values):
    found = exact_quantiles(long_frame(spark, {0: values}), [0.1, 0.5, 0.77], {0: len(values)}, 5)
    want = np.quantile(values, [0.1, 0.5, 0.77])
    assert found.first()["q"] == pytest.approx(list(want), rel=1e-9, abs=1e-9)


def test_histogram_equals_numpy(spark):
    rng = random.Random(1)
    for values, k in (
        ([rng.expovariate(1 / 50) for _ in range(500)], 33),
        ([float(v) for v in range(1, 51)], 7),
        ([round(0.1 * i, 1) for i in range(101)], 10),
        ([3.0] * 4, 5),
    ):
        df = spark.createDataFrame([(v,) for v in values], "value double")
        rows = histogram(df, min(values), max(values), k).orderBy("bin").collect()
        counts, edges = np.histogram(values, bins=k)
        assert [r["n"] for r in rows] == counts.tolist()
        assert [r["lo"] for r in rows] == pytest.approx(edges[:-1].tolist())
        assert sum(r["n"] for r in rows) == len(values)
    labels = [r["label"] for r in histogram(df, 0.0, 3.0, 2).orderBy("bin").collect()]
    assert labels == ["0.0–1.5", "1.5–3.0"]


def test_bin_count():
    assert bin_count(1000, 0, 100, 50) == 10
    assert bin_count(1000, 0, 100, 0) == math.ceil(math.log2(1000) + 1)
    assert bin_count(10, 0, 100, 90) == 5
    assert bin_count(10**6, 0, 1e9, 1) == 60


def test_spread_metrics(spark):
    values = [1.0] * 30 + [2.0] * 30 + [100.0]
    facts = {
        "min": 1.0, "max": 100.0, "mean": float(np.mean(values)), "std": float(np.std(values, ddof=1)),
        "q1": 1.0, "q3": 2.0, "n_valid": len(values),
    }
    constant = {"min": 5.0, "max": 5.0, "mean": 5.0, "std": 0.0, "q1": 5.0, "q3": 5.0, "n_valid": 9}
    long = long_frame(spark, {0: values, 1: [5.0] * 9})
    found = by_pos(spread_metrics(long, {0: facts, 1: constant}))
    assert (found[0]["outliers_iqr"], found[0]["outliers_z"]) == (1, 1)
    hist = np.histogram(values, bins=20)[0] / len(values)
    entropy = -sum(p * math.log2(p) for p in hist if p)
    assert found[0]["numeric_entropy"] == pytest.approx(entropy)
    assert (found[1]["outliers_iqr"], found[1]["outliers_z"], found[1]["numeric_entropy"]) == (0, 0, 0)


def test_category_metrics(spark):
    rows = [(0, "b")] * 3 + [(0, "a")] * 3 + [(0, "c")] * 2 + [(1, "only")] * 4
    counts = value_counts(spark.createDataFrame(rows, "pos int, value string"), "pos", "value")
    found = by_pos(category_metrics(counts))
    assert found[0]["top_values"] == ["a", "b", "c"] and found[0]["dominant_value"] == "a"
    assert found[0]["gini_impurity"] == pytest.approx(1 - (9 + 9 + 4) / 64)
    assert 0 <= found[0]["categorical_entropy"] <= math.log2(3)
    assert found[1]["normalised_entropy"] == pytest.approx(0, abs=1e-9)
    assert (found[1]["dominant_rate"], found[1]["balance_score"]) == (100, 0)


def test_long_texts_are_counted_by_digest(spark):
    df = spark.createDataFrame([("x" * 50,), ("x" * 50,), ("y" * 50,), (None,)], "t string")
    for longest in (10, 50):
        long = to_long(df, {0: text_key(F.col("t"), longest)})
        assert distinct_counts(long).first()["n_unique"] == 2


def test_frequency_encode_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "`c.d` string")
    rows = [(r["c.d"], r["freq"]) for r in frequency_encode(df, "c.d", "freq").collect()]
    assert sorted(rows, key=str) == sorted([("a", 2), ("a", 2), ("b", 1), (None, None)], key=str)


def dates_frame(spark, columns):
    rows = [(pos, day) for pos, days in columns.items() for day in days]
    return spark.createDataFrame(rows, "pos int, value timestamp_ntz").repartition(3)


def test_gaps(spark):
    start = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    columns = {
        0: [start + i * day for i in range(10)],
        1: [start + 7 * i * day for i in range(10)],
        2: [start] * 6 + [start + 3 * day],
        3: [start + dt.timedelta(hours=13 * i) for i in range(12)],
        4: [start],
    }
    long = dates_frame(spark, columns)
    found = by_pos(gap_metrics(long))
    assert (found[0]["median_gap_days"], found[0]["regularity_pct"]) == (1, 100)
    assert (found[1]["median_gap_days"], found[1]["regularity_pct"]) == (7, 100)
    assert (found[2]["median_gap_days"], found[2]["regularity_pct"]) == (0, None)
    # consecutive stamps 13 hours apart are never a full day apart
    assert found[3]["median_gap_days"] == 0
    assert 4 not in found
    assert by_pos(date_spans(long))[3]["range_days"] == 5


def test_gaps_equal_a_plain_sort(spark):
    rng = random.Random(3)
    stamps = [dt.datetime(2020, 1, 1) + dt.timedelta(minutes=rng.randint(0, 400_000)) for _ in range(300)]
    found = gap_metrics(dates_frame(spark, {0: stamps})).first()
    ordered = sorted(stamps)
    gaps = [(b - a).days for a, b in zip(ordered, ordered[1:])]
    assert found["median_gap_days"] == float(np.median(gaps))


def test_row_numbers_follow_the_order(spark):
    keys = list(range(500))
    random.Random(2).shuffle(keys)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k int, v string").repartition(6)
    rows = with_ordinal(df, ["k"]).collect()
    assert all(r["_rid"] == r["k"] for r in rows) and len(rows) == 500
    numbered = with_ordinal(df, ["k"])
    assert every_nth(numbered, 500, 200).count() == 250
    assert is_row_number(numbered, F.col("k").cast("double")).first()[0]
    assert not is_row_number(numbered, F.col("k") + F.lit(1.0)).first()[0]


def test_rows_with_equal_keys_are_split(spark):
    df = spark.range(0, 20_000, 1, 8).select("id", F.when(F.col("id") < 9_000, 5).otherwise(F.col("id")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = in_order(df, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 9_000
    rows = with_ordinal(df, ["k"]).collect()
    assert sorted(r["_rid"] for r in rows) == list(range(20_000))
    ordered = [r["k"] for r in sorted(rows, key=lambda r: r["_rid"])]
    assert ordered == sorted(ordered)


def test_row_numbers_without_order_are_complete(spark):
    rows = with_ordinal(spark.range(100).repartition(7)).collect()
    assert sorted(r["_rid"] for r in rows) == list(range(100))


def test_monotonic_flags(spark):
    n = 400
    rows = [
        (i, float(i), float(-i), 1.0, float(i) if i != 200 else 0.0, None if i % 3 else float(i // 7))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "k int, up double, down double, flat double, dip double, gaps double")
    values = {i: F.col(c) for i, c in enumerate(("up", "down", "flat", "dip", "gaps"))}
    want = {0: (True, False), 1: (False, True), 2: (True, True), 3: (False, False), 4: (True, False)}
    for parts in (1, 5, 16):
        assert monotonic_flags(df.repartition(parts), values, ["k"]) == want


def test_monotonic_break_between_partitions(spark):
    df = spark.range(0, 100, 1, 4)  # 25 rows each
    dropped = F.when(F.col("id") < 25, F.col("id") + 1000).otherwise(F.col("id")).cast("double")
    assert monotonic_flags(df, {0: dropped}) == {0: (False, False)}


def test_order_words_keep_the_order_of_doubles_and_timestamps():
    values = [-math.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.5, 1e300, math.inf]
    words = order_words(pa.array(values)).tolist()
    assert words == sorted(set(words))
    assert order_words(pa.array([0.0, None, -0.0])).tolist() == [0, 0]
    days = pa.array([0, None, -5, 7], pa.timestamp("us"))
    assert order_words(days).tolist() == [0, -5, 7]


@pytest.mark.parametrize("size", [2, 3, 1024])
def test_runs_join_to_the_same_whole_in_any_steps(spark, size):
    rng = random.Random(4)
    columns = {
        0: sorted(rng.random() for _ in range(200)),
        1: sorted((rng.random() for _ in range(200)), reverse=True),
        2: [1.0] * 200,
        3: [float(i) if i != 137 else 5.0 for i in range(200)],
        4: [None if i < 150 else float(i) for i in range(200)],
    }
    rows = list(zip(range(200), *columns.values()))
    df = spark.createDataFrame(rows, "k int, c0 double, c1 double, c2 double, c3 double, c4 double")
    ordered = df.repartitionByRange(11, "k").sortWithinPartitions("k")
    runs = monotonic_runs(ordered, {i: F.col(f"c{i}") for i in columns})
    while runs.groupBy("pos").count().where("count > 1").count():
        runs = join_runs(runs, size)
    got = {r["pos"]: (r["rising"], r["falling"]) for r in runs.collect()}
    assert got == {0: (True, False), 1: (False, True), 2: (True, True), 3: (False, False), 4: (True, False)}


def test_dates_fall_by_a_microsecond_between_partitions(spark):
    late = dt.datetime(2300, 1, 1, 2, 30, 0, 7)
    rows = [(i, late + dt.timedelta(microseconds=i - 2 * (i >= 50))) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz").repartition(6)
    flags = monotonic_flags(df.where("k < 50"), {0: F.col("t")}, ["k"])
    assert flags == {0: (True, False)}
    assert monotonic_flags(df, {0: F.col("t")}, ["k"]) == {0: (False, False)}


def test_quantiles_of_columns_side_by_side(spark):
    n = 300_000
    df = spark.range(n).select(
        (F.col("id") * 7919 % n).cast("double").alias("mixed"),
        F.col("id").cast("double").alias("rising"),
        F.when(F.col("id") % 3 == 0, 1e9).otherwise(F.sqrt("id")).alias("heavy"),
        F.when(F.col("id") % 4 == 0, F.col("id") % 10).cast("double").alias("gaps"),
    )
    table = df.toPandas()
    values = {i: F.col(c) for i, c in enumerate(df.columns)}
    sizes = {i: int(table[c].count()) for i, c in enumerate(df.columns)}
    for direct_rows in (1_000, 100_000, 1_000_000):
        found = column_quantiles(df, values, QUANTILES, sizes, direct_rows)
        for i, c in enumerate(df.columns):
            want = np.quantile(table[c].dropna(), QUANTILES)
            assert found[i] == pytest.approx(list(want), rel=1e-12), (c, direct_rows)


def test_large_brackets_are_thinned_evenly(spark):
    n = 1 << 20
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v"))
    bracket = Bracket(0, float("-inf"), float("inf"), 0, n, (0,))
    rows = _thinned(column_cells(df, {0: F.col("v")}), [bracket])
    assert "Generate" not in rows._jdf.queryExecution().toString()
    sample = np.sort([r["value"] for r in rows.collect()])
    assert len(sample) == pytest.approx(n / 16, rel=0.01)
    grid = sample[np.linspace(0, len(sample) - 1, 65).astype(int)]
    assert np.abs(grid / n - np.linspace(0, 1, 65)).max() < 1 / 1024


@pytest.mark.parametrize("most_sums", [1000, 0])
def test_correlations_are_pairwise_complete(spark, most_sums):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        x = rng.random()
        rows.append((x, None if i % 5 == 0 else x * 2 + rng.random(), 0.1, None if i % 2 else rng.random()))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    values = {i: F.col(c) for i, c in enumerate("abcd")}
    found = {(r["pos_a"], r["pos_b"]): r for r in correlation_pairs(df, values, most_sums).collect()}
    table = np.array([[np.nan if v is None else v for v in row] for row in rows])
    for i, j in ((0, 1), (0, 3), (1, 3)):
        both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
        want = np.corrcoef(table[both, i], table[both, j])[0, 1]
        assert found[i, j]["r"] == pytest.approx(want, abs=1e-12)
        assert found[i, j]["n"] == both.sum()
    assert all(found[pair]["r"] is None for pair in ((0, 2), (1, 2), (2, 3)))


def test_many_correlations_are_no_single_aggregate(spark, monkeypatch):
    """A hundred sums in one aggregate are slower than matrix products."""
    from tabulens.operators import correlation

    taken = []
    by_block = correlation._sums_by_block
    monkeypatch.setattr(
        correlation, "_sums_by_block", lambda *args: taken.append(1) or by_block(*args)
    )
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(11)])
    pairs = correlation_pairs(df, {i: F.col(f"c{i}") for i in range(11)}).collect()
    table = df.toPandas().corr()
    assert taken and len(pairs) == 55
    for row in pairs:
        want = table.iloc[row["pos_a"], row["pos_b"]]
        assert row["r"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("most_sums", [1000, 0])
def test_correlations_of_rows_far_from_the_means(spark, most_sums):
    """Few rows share a value, and these lie far from the mean of one column."""
    rng = random.Random(8)
    rows = [(float(i % 3 + 7), rng.random(), 5.0) for i in range(300)]
    rows += [(1e8 + i, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    values = {i: F.col(c) for i, c in enumerate("abc")}
    found = {(r["pos_a"], r["pos_b"]): r for r in correlation_pairs(df, values, most_sums).collect()}
    want = np.corrcoef(*np.array([row[:2] for row in rows[:300]]).T)[0, 1]
    assert found[0, 1]["r"] == pytest.approx(want, abs=1e-6)
    assert found[0, 1]["n"] == 300
    assert found[0, 2]["r"] is None and found[1, 2]["r"] is None


def test_line_fit(spark):
    points = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "x double, y double")
    row = line_fit(points).first()
    assert (row["slope"], row["intercept"], row["y_start"], row["y_end"]) == (2, 1, 3, 7)
    assert line_fit(points.limit(2)).count() == 0
    constant = spark.createDataFrame([(1.0, v) for v in (1.0, 2.0, 3.0)], "x double, y double")
    assert line_fit(constant).count() == 0


def test_density(spark):
    rng = random.Random(4)
    values = [rng.gauss(10, 3) for _ in range(200)]
    df = spark.createDataFrame([("g", v) for v in values] + [("flat", 1.0)] * 5, "grp string, value double")
    std = float(np.std(values, ddof=1))
    rows = density(df, [("g", min(values), max(values), std, 200), ("flat", 1.0, 1.0, 0.0, 5)]).collect()
    assert {r["grp"] for r in rows} == {"g"} and len(rows) == 60
    h = std * 200 ** (-1 / 5)
    for r in rows:
        kernel = np.exp(-0.5 * ((np.array(values) - r["x"]) / h) ** 2).sum()
        assert r["density"] == pytest.approx(kernel / (200 * h * math.sqrt(2 * math.pi)))


def group_frame(spark, sizes):
    rows = [(g, i, float(i)) for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "grp string, k int, value double").repartition(3)


def test_small_groups_are_dropped(spark):
    df = group_frame(spark, {"a": 5, "b": 4, "c": 9})
    assert groups.drop_small_groups(df, "grp").count() == 14
    lonely = group_frame(spark, {"a": 5, "b": 4})
    assert groups.drop_small_groups(lonely, "grp").count() == 0


def test_box_summary_lists_first_outliers_in_row_order(spark):
    rows = [("g", i, float(i % 10)) for i in range(400)] + [("g", 1000 - i, 100.0 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "grp string, k int, value double").repartition(5)
    for direct_rows in (10**6, 20):
        row = groups.box_summary(df, [("g", 440)], ["k"], direct_rows=direct_rows).first()
        values = [r[2] for r in rows]
        assert (row["q1"], row["median"], row["q3"]) == tuple(np.quantile(values, [0.25, 0.5, 0.75]))
        assert row["outliers"] == [100.0 + i for i in range(39, 9, -1)]


def test_crosstab_and_heatmap_fill_gaps(spark):
    rows = [("x", "p")] * 3 + [("y", "q")] * 2 + [("z", "p")]
    pairs = spark.createDataFrame(rows, "grp string, other string")
    cells = {(r["grp"], r["other"]): r["n"] for r in groups.crosstab(pairs, 2, 2).collect()}
    assert cells == {("x", "p"): 3, ("x", "q"): 0, ("y", "p"): 0, ("y", "q"): 2}
    heat = groups.category_heatmap(pairs).collect()
    assert len(heat) == 6 and {(r["grp"], r["x_rank"]) for r in heat} == {("x", 1), ("y", 2), ("z", 3)}


def test_means_of_groups(spark):
    df = group_frame(spark, {"a": 5, "b": 1, "c": 9})
    rows = groups.group_means(df).collect()
    assert [(r["grp"], r["mean"], r["n"]) for r in rows] == [("c", 4.0, 9), ("a", 2.0, 5), ("b", 0.0, 1)]
    assert rows[2]["std"] == 0
    assert [r["grp"] for r in groups.lowest_means(df, 2).collect()] == ["b", "a"]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(2000).select("id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    one = {r["id"] for r in sample_rows(df.coalesce(1), ["id"], 50).collect()}
    many = {r["id"] for r in sample_rows(df.repartition(9), ["id"], 50).collect()}
    assert one == many and len(one) == 50


def test_scatter_outliers(spark):
    rows = [(i, float(i % 7), 1.0 + i % 3) for i in range(50)] + [(99, 500.0, 1.0)]
    points = spark.createDataFrame(rows, "id int, x double, y double")
    assert [tuple(r) for r in scatter_outliers(points, ["id"]).collect()] == [(500.0, 1.0)]

"""Profiles from sketches against exact ones."""

import datetime as dt
import random

import numpy as np
import pytest

import tabulens
from tabulens.operators.summaries import LEVEL, PIECE, Ranks
from tabulens.plans.sketches import DISTINCT_ERROR, RANK_ERROR

SAME = (
    "type total missing missing_rate mean std variance min max range cv_pct zero_count negative_count"
    " n_valid skewness kurtosis skew_type distribution dominant_value dominant_rate top_values"
    " top_counts top_pcts categorical_entropy normalised_entropy balance_score gini_impurity"
    " cardinality_ratio min_date max_date range_days avg_length max_length min_length blank_count"
    " blank_rate"
).split()


@pytest.fixture(scope="module")
def frame(spark):
    draw = random.Random(1)
    rows = []
    for i in range(6000):
        rows.append(
            (
                i, draw.choice([None, float("nan"), 0.0, draw.gauss(50, 9), draw.expovariate(0.1)]),
                draw.choice(["a", "b", "b", None, " "]), f"text {draw.randrange(4000)}",
                str(draw.randrange(50)) + draw.choice(["", ".5"]), 7.0, None,
                dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 400),
                f"2024-0{1 + i % 9}-11", [1, 2], i % 2 == 0,
            )
        )
    schema = (
        "id long, v double, c string, t string, n string, k double, e string, d timestamp_ntz,"
        " s string, a array<int>, b boolean"
    )
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def by_column(prof):
    return {r["column"]: r for r in prof.collect()}


def check(got, want):
    assert set(got) == set(want)
    for name, row in want.items():
        for metric in SAME:
            value = got[name][metric]
            if isinstance(row[metric], float):
                assert value == pytest.approx(row[metric], rel=1e-3, abs=1e-3), (name, metric)
            else:
                assert value == row[metric], (name, metric)
        for metric in ("n_unique_vals", "unique_count", "unique_dates"):
            if row[metric] is not None:
                assert got[name][metric] == pytest.approx(row[metric], rel=DISTINCT_ERROR)
        assert got[name]["is_discrete"] == row["is_discrete"]


def test_a_sketched_profile_is_near_the_exact_one(frame):
    want = by_column(tabulens.profile(frame, ["id"]))
    got = by_column(tabulens.profile(frame, ["id"], exact=False))
    check(got, want)
    values = sorted(r.v for r in frame.select("v").collect() if r.v is not None and r.v == r.v)
    for p, metric in ((0.05, "p05"), (0.25, "q1"), (0.5, "median"), (0.95, "p95")):
        place = sum(x <= got["v"][metric] for x in values) / len(values)
        before = sum(x < got["v"][metric] for x in values) / len(values)
        assert before - RANK_ERROR <= p <= place + RANK_ERROR
    allowed = 2 * RANK_ERROR * len(values)
    for metric in ("outliers_iqr", "outliers_z"):
        assert abs(got["v"][metric] - want["v"][metric]) <= allowed
    assert got["v"]["numeric_entropy"] == pytest.approx(want["v"]["numeric_entropy"], abs=0.1)


def test_parts_add_up(spark, frame):
    """Merged in any grouping, also with empty parts, the parts give the sketch of the whole."""
    want = by_column(tabulens.profile(frame, ["id"]))
    parts = [
        tabulens.sketch(frame.where(f"id % 7 IN ({keys})")) for keys in ("0, 1", "2", "3, 4, 5, 6")
    ]
    empty = tabulens.sketch(frame.where("id < 0"))
    pair = tabulens.merge_sketches(parts[0], empty, parts[1])
    check(by_column(tabulens.sketched_profile(tabulens.merge_sketches(parts[2], pair))), want)


def test_sketches_can_be_stored(spark, frame, tmp_path):
    path = str(tmp_path / "sketches")
    tabulens.sketch(frame).write.parquet(path)
    stored = spark.read.parquet(path)
    check(by_column(tabulens.sketched_profile(stored)), by_column(tabulens.profile(frame, ["id"])))


def test_one_scan(frame):
    plan = tabulens.sketch(frame.drop("c", "t", "n", "e", "s"))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("InMemoryTableScan") == 1


def test_many_distinct_values(spark):
    df = spark.range(30_000).selectExpr("id", "concat('v', id % 20000) AS t", "id % 700 AS m")
    got = by_column(tabulens.profile(df, exact=False))
    for name, count in (("id", 30_000), ("t", 20_000), ("m", 700)):
        found = got[name]["n_unique_vals"] or got[name]["unique_count"]
        assert found == pytest.approx(count, rel=DISTINCT_ERROR)


def test_no_rows(frame):
    rows = tabulens.profile(frame.where("false"), exact=False).collect()
    assert rows == [] or {r["type"] for r in rows} <= {"text", "nested"}


def test_cells_are_not_lined_up(frame):
    """A row is one row to the scan, however many columns it has."""
    plan = tabulens.sketch(frame)._jdf.queryExecution().toString()
    assert "Generate" not in plan.split("== Physical Plan ==")[1]


def test_zeros_are_one_value(spark):
    df = spark.createDataFrame([(-0.0,), (0.0,), (1.0,), (None,)], "v double")
    assert by_column(tabulens.profile(df, exact=False))["v"]["n_unique_vals"] == 2


def test_texts_of_any_length(spark):
    """Long texts are counted as values and not listed; counts of the others stay exact."""
    texts = ["a", "a", "b", "x" * 256, "x" * 257, "y" * 5000, "y" * 5000, None, " "]
    df = spark.createDataFrame([(t,) for t in texts * 30], "t string").repartition(3)
    parts = [df.limit(0), df.where("t < 'b'"), df.where("t >= 'b' OR t IS NULL")]
    for sketches in (tabulens.sketch(df), tabulens.merge_sketches(*map(tabulens.sketch, parts))):
        row = by_column(tabulens.sketched_profile(sketches))["t"]
        assert (row["type"], row["total"], row["missing"]) == ("categorical", 270, 30)
        assert row["unique_count"] == 6
        found = dict(zip(row["top_values"], row["top_counts"], strict=True))
        assert found == {"a": 60, "b": 30, "x" * 256: 30, " ": 30}


def test_days_and_decimals(spark):
    df = spark.range(5000).selectExpr(
        "date_add(DATE'2024-01-01', CAST(id % 300 AS int)) AS d",
        "CAST(id % 70 / 4 AS decimal(9, 2)) AS m",
        "id * 1000003 AS k",
    )
    got = by_column(tabulens.profile(df, exact=False))
    assert (got["d"]["unique_dates"], got["m"]["n_unique_vals"]) == (300, 70)
    assert got["m"]["max"] == 17.25
    assert got["k"]["n_unique_vals"] == pytest.approx(5000, rel=DISTINCT_ERROR)


def test_ranks_of_many_merged_parts():
    """The error stays in its bound, however the rows are dealt and merged; no row is lost."""
    draw = np.random.default_rng(5)
    for values in (draw.normal(size=1_000_003), np.arange(700_001.0), draw.integers(0, 9, 400_000) * 1.0):
        whole = Ranks((0,))
        for i, part in enumerate(np.array_split(values, 61)):
            own = Ranks((1, i))
            for start in range(0, len(part), PIECE // 9):
                own.add(np.sort(part[start : start + PIECE // 9]))
            whole.merge(own)
        assert sum(len(v) << i for i, v in enumerate(whole.levels)) == len(values)
        assert all(len(v) < LEVEL for v in whole.levels)
        wanted = np.linspace(0.01, 0.99, 99)
        found = whole.quantiles(wanted)
        ordered = np.sort(values)
        below = np.searchsorted(ordered, found, "left") / len(values)
        upto = np.searchsorted(ordered, found, "right") / len(values)
        assert (below - RANK_ERROR <= wanted).all() and (upto + RANK_ERROR >= wanted).all()


def test_ranks_of_few_rows_are_exact():
    ranks = Ranks((0,))
    ranks.add(np.arange(101.0))
    assert ranks.quantiles([0.0, 0.5, 1.0]) == [0.0, 50.0, 100.0]
    assert Ranks((0,)).quantiles([0.5]) is None

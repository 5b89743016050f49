"""Accumulators: any split of the rows gives the facts of all, and one scan gives the types."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabulens.operators import frequency
from tabulens.operators.accumulate import LISTED, SHORT, Facts, column_facts
from tabulens.operators.bins import column_spread, spread_metrics
from tabulens.operators.frequency import number_counts, to_long, value_counts
from tabulens.operators.moments import moments
from tabulens.plans import profile as plans
from tabulens.plans.types import detect_types

numbers = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6).map(lambda v: round(v, 3))), max_size=40)


def facts_of(values):
    facts = Facts()
    facts.add(len(values), {"number": pa.array(values, pa.float64())})
    return facts


@settings(max_examples=150, deadline=None)
@given(st.lists(numbers, min_size=1, max_size=5))
def test_parts_add_up(parts):
    merged = Facts()
    for part in parts:
        merged.merge(facts_of(part))
    whole = facts_of([v for part in parts for v in part])
    assert (merged.total, merged.present, merged.n) == (whole.total, whole.present, whole.n)
    assert (merged.low, merged.high, merged.zeros) == (whole.low, whole.high, whole.zeros)
    if merged.n < 2:
        return
    got, want = merged.moments(), whole.moments()
    spread = want["max"] - want["min"]
    assert got["mean"] == pytest.approx(want["mean"], abs=1e-9 * (1 + spread))
    assert got["std"] == pytest.approx(want["std"], rel=1e-9, abs=1e-12)
    if want["std"] > 1e-4 * spread > 0:
        assert got["skewness"] == pytest.approx(want["skewness"], rel=1e-6, abs=1e-6)
        assert got["kurtosis"] == pytest.approx(want["kurtosis"], rel=1e-6, abs=1e-6)


def test_facts_equal_the_aggregates(spark):
    values = F.when(F.col("id") % 11 != 0, F.round(F.pow(F.rand(3), 3) * 50 - 3, 2))
    df = spark.range(0, 5000, 1, 7).select(values.alias("v"), F.lit(0.1).alias("c"))
    cells = {0: {"number": F.col("v")}, 1: {"number": F.col("c")}}
    found = column_facts(df, cells)
    for row in moments(to_long(df, {0: F.col("v"), 1: F.col("c")})).collect():
        got = found[row["pos"]].moments()
        assert got["n_valid"] == row["n_valid"] and got["all_integers"] == row["all_integers"]
        for name in ("mean", "std", "min", "max", "skewness", "kurtosis"):
            want = row[name]
            assert got[name] is None if want is None else got[name] == pytest.approx(want, abs=1e-9)
        for name in ("zero_count", "negative_count"):
            assert got[name] == row[name]


def test_values_are_listed_while_few_and_short():
    def words(*batches, longest=3):
        facts = Facts(longest=longest)
        for batch in batches:
            facts.add(len(batch), {"word": pa.array(batch, pa.binary())})
        return facts.texts()

    assert words([b"a", b"b", None], [b"a"]) == {"a": 2, "b": 1}
    assert words([b"%d" % i for i in range(LISTED)]) is not None
    assert words([b"%d" % i for i in range(60)], [b"%d" % i for i in range(50, 101)]) is None
    assert words([b"a"], longest=SHORT + 1) is None
    assert words([b"\xff\xfe"]) is None
    assert words([]) == {}


def test_number_counts_are_the_value_counts(spark, monkeypatch):
    monkeypatch.setattr(frequency, "GATHERED", 64)
    hot = F.when(F.col("id") % 3 == 0, -0.0).otherwise(F.col("id") * 1.0)
    df = spark.range(0, 3000, 1, 5).select(
        hot.alias("a"), F.when(F.col("id") > 2990, F.lit(2)).alias("b"), F.lit(0.0).alias("z")
    )
    values = {0: F.col("a"), 4: F.col("b"), 7: F.col("z")}
    plain = value_counts(to_long(df, {p: c.cast("double") for p, c in values.items()}), "pos", "value")
    rows = number_counts(df, values).collect()
    assert sorted(rows) == sorted(plain.collect()) and (0, 0.0, 1000) in rows
    assert number_counts(df.where("false"), values).count() == 0


def test_spread_side_by_side(spark):
    df = spark.range(0, 900, 1, 4).selectExpr("pow(id % 90, 2) AS a", "if(id > 3, 5.0D, NULL) AS b")
    values = {0: F.col("a"), 1: F.col("b")}
    facts = {p: f.moments() for p, f in column_facts(df, {p: {"number": c} for p, c in values.items()}).items()}
    params = {p: m | {"q1": m["min"], "q3": m["mean"]} for p, m in facts.items()}
    got = {r["pos"]: r for r in column_spread(df, values, params).collect()}
    assert got == {r["pos"]: r for r in spread_metrics(to_long(df, values), params).collect()}
    v = np.array([float((i % 90) ** 2) for i in range(900)])
    share = np.histogram(v, bins=20)[0] / 900
    assert got[0]["numeric_entropy"] == pytest.approx(-sum(p * np.log2(p) for p in share if p))
    assert got[1]["numeric_entropy"] == 0


def test_scans_of_a_profile(spark, tmp_path, monkeypatch):
    """Types and categories take one scan; counts, spread and dates one more each."""
    path = str(tmp_path / "t")
    spark.range(500).selectExpr(
        "id", "id * 0.5D AS half", "concat('g', id % 3) AS g", "id % 2 = 0 AS yes",
        "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id)) AS ts",
    ).write.parquet(path)
    df = spark.read.parquet(path)
    scans = []
    kind = type(df)
    plain = kind.mapInArrow
    monkeypatch.setattr(
        kind, "mapInArrow", lambda self, *a, **k: (scans.append(self), plain(self, *a, **k))[1]
    )
    lined_up = []
    monkeypatch.setattr(plans, "to_long", lambda *a: (lined_up.append(a), to_long(*a))[1])
    types = detect_types(df)
    rows = {m["column"]: m for m in plans.column_metrics(df, (), types)}
    from_table = [f for f in scans if f.inputFiles() and "Exchange" not in _plan(f)]
    # types, number counts, spread, order
    assert len(from_table) == 4
    # the long form is made twice, once only for quantiles beyond a million rows: dates take one scan
    assert len(lined_up) == 2
    assert rows["g"]["top_counts"] == [167, 167, 166]
    assert (rows["ts"]["unique_dates"], rows["ts"]["median_gap_days"]) == (500, 1)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()

"""Plan shapes and skew: what must hold when the data no longer fits one task."""

import pytest
from pyspark.sql import functions as F

from tabulens.operators import groups
from tabulens.operators.frequency import top_k, value_counts
from tabulens.operators.gaps import gap_metrics
from tabulens.operators.moments import moments
from tabulens.operators.ordinal import monotonic_flags, with_ordinal
from tabulens.operators.frequency import to_long
from tabulens.operators.quantiles import exact_quantiles
from tabulens.plans.profile import column_metrics


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "t")
    spark.range(5000).selectExpr(
        "id", "double(id) AS a", "id % 7 AS b", "concat('g', id % 3) AS g", "repeat('x', 50) AS wide"
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_scans_read_only_needed_columns(stored):
    text = plan(moments(to_long(stored, {0: F.col("a")})))
    assert "[a#" in text.split("FileScan")[1].split("]")[0] + "]" and "wide" not in text
    text = plan(top_k(value_counts(stored, "g"), 5, "g"))
    assert "wide" not in text and "TakeOrderedAndProject" in text


def test_sums_are_combined_before_the_shuffle(stored):
    text = plan(moments(to_long(stored, {0: F.col("a"), 1: F.col("b").cast("double")})))
    assert text.count("Exchange") == 1 and "partial_avg" in text
    assert "Python" not in text and "ArrowEval" not in text


def test_no_window_over_the_whole_table(stored):
    stamped = stored.select(F.timestamp_seconds(F.col("id") * 50_000).cast("timestamp_ntz").alias("ts"))
    text = plan(gap_metrics(to_long(stamped, {0: F.col("ts")})))
    assert "SinglePartition" not in text
    # the window sees one row per day, never the rows themselves
    assert text.index("Window") < text.rindex("HashAggregate")


def test_filter_reaches_the_scan(stored):
    text = plan(groups.top_groups(stored.select(F.col("g").alias("grp")).where("grp = 'g1'"), 3))
    assert "PushedFilters: [EqualTo" in text


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, one group and one date."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, 30_000, 1, 8).select(
        "id",
        F.when(hot, 7.0).otherwise(F.col("id") * 1.0).alias("v"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
    )


def test_quantiles_of_a_hot_value(skewed):
    long = skewed.select(F.lit(0).alias("pos"), F.col("v").alias("value"))
    wanted = [0.01, 0.2, 0.3333, 0.34, 0.5, 0.99]
    plain = exact_quantiles(long, wanted, {0: 30_000}).first()["q"]
    assert exact_quantiles(long, wanted, {0: 30_000}, 100).first()["q"] == plain


def test_box_of_a_hot_group(skewed):
    values = skewed.select(F.col("g").alias("grp"), F.col("id").cast("double").alias("value"))
    sizes = groups.group_sizes(groups.top_groups(values, 3))
    assert sizes[0] == ("hot", 10_000)
    plain = {r["grp"]: r for r in groups.box_summary(values, sizes).collect()}
    narrowed = {r["grp"]: r for r in groups.box_summary(values, sizes, direct_rows=50).collect()}
    assert plain == narrowed and plain["hot"]["median"] == 14998.5


def test_members_of_many_groups(skewed):
    """The hot group is not shuffled, and the rows are those of a plain join."""
    keyed = skewed.withColumn("k", F.when(F.col("g") == "hot", "hot").otherwise((F.col("id") % 7000).cast("string")))
    kept = value_counts(keyed, "k").where("n >= 3")
    found, rows = kept.count(), kept.agg(F.sum("n")).first()[0]
    plain = sorted(keyed.join(kept, "k", "left_semi").select("id").collect())
    few = groups.members(keyed, kept, "k", found, rows)
    many = groups.members(keyed, kept, "k", found, rows, most=100)
    assert sorted(few.select("id").collect()) == plain
    assert sorted(many.select("id").collect()) == plain and 10_000 < len(plain) < 30_000
    text = plan(many)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text
    # of the table, only what is left of the tail is shuffled
    by_key = many.where("k <> 'hot'").groupBy("k").count()
    assert by_key.agg(F.max("count")).first()[0] <= 30_000 * groups.HOT_SHARE


@pytest.mark.parametrize("length", [3, 60])
def test_small_groups_of_long_names(spark, length):
    rows = [("a" * length, 1)] * 5 + [("b" * length, 2)] * 6 + [("c" * length, 3)] * 4 + [(None, 4)] * 9
    df = spark.createDataFrame(rows, "`_group` string, `a.b` int")
    got = groups.drop_small_groups(df, "_group")
    assert got.columns == df.columns
    assert sorted(r["a.b"] for r in got.collect()) == [1] * 5 + [2] * 6
    assert groups.drop_small_groups(df, "_group", min_groups=3).count() == 0
    assert groups.drop_small_groups(df, "a.b").count() == 20
    assert groups.drop_small_groups(df.where("false"), "_group").count() == 0


def test_row_order_does_not_depend_on_the_split(skewed):
    one = {r["id"]: r["_rid"] for r in with_ordinal(skewed.coalesce(1), ["v", "id"]).collect()}
    many = {r["id"]: r["_rid"] for r in with_ordinal(skewed.repartition(13), ["v", "id"]).collect()}
    assert one == many
    rising = {0: F.col("v"), 1: F.col("id").cast("double")}
    assert monotonic_flags(skewed.repartition(13), rising, ["v"])[0] == (True, False)


def test_hundreds_of_columns(spark):
    names = [f"c{i}" for i in range(120)]
    df = spark.range(40).select(
        *[(F.col("id") * (i + 1) % 11).cast("string" if i % 2 else "int").alias(n) for i, n in enumerate(names)]
    )
    metrics = column_metrics(df)
    assert [m["column"] for m in metrics] == names
    assert all(m["type"] == "numeric" and m["n_unique_vals"] in (1, 11) for m in metrics)

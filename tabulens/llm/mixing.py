"""Mixing sources to target weights by Pareto order sampling.

Sources share a number of words by weight; no source gives more than ``cap`` times its own words,
and what a source cannot give is shared again among the others. A document of a source is then
expected ``target / words of the source`` times (times its own weight, where one is given). The
whole part of that number is certain: so many copies are taken. The rest is its inclusion
probability p in a fixed-size sample: documents are ranked by the odds of a random number over the
odds of p (Pareto order sampling) and taken from the smallest rank on while they fit into what the
source still lacks. Where the next document does not fit, the ranking is gone on with among those
that do, ``rounds`` times in all, so that one long document does not leave a gap.

How it runs: one pass over the texts leaves a narrow table (source, size, rank). The place where a
source is full is found from sums over cells of the rank, first of 1/1024, then of 1/2^20 of its
range, and only the rows of the last cell are ordered: no task orders a source. What is kept is one
row per source; documents read their decision from it without meeting each other.

Random numbers are a digest of the seed and the id: reruns and any partitioning agree.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a source
without words has target 0; rows that agree in id, source and size draw the same number and are
taken or left together; extra columns are kept, an input column named like a result is replaced; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.session import pin

from .texts import bind, settled, whole, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
ROUNDS = 4
SEED = "mix-1"
# Up to so many sources their table (a few numbers each) is sent to every executor.
BROADCAST_SOURCES = 20_000
CELLS = (2**10, 2**20)


def word_count(text_col: str = "text") -> Column:
    """The size of a document: its words."""
    return F.size(words(whole(text_col))).cast("long")


def source_key(source_col: str) -> Column:
    """Text that orders sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col(f"`{source_col}`").cast("string")), F.lit("b"))


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
) -> DataFrame:
    """From (key, source_size), one row per source: the same with its target.

    Weights repeat along the ordered sources. With the sources ordered by the level at which each
    is full, the level that spends the whole share is the first one that does not exceed the next
    source's; from there on levels fall, as sources are counted as full that are not.
    """
    by_name = Window.orderBy("key")
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", "key").rowsBetween(Window.unboundedPreceding, -1)
    place = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    weighted = (
        sizes.withColumn("weight", F.array(*(F.lit(float(w)) for w in weights))[place])
        .withColumn("limit", F.col("source_size") * cap)
        .withColumn("full_at", F.col("limit") / F.col("weight"))
    )
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(
        F.sum("limit").over(before), F.lit(0)
    )
    open_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    levels = weighted.withColumn("level", left / open_weight)
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    target = F.least(F.col("limit").cast("double"), level * F.col("weight"))
    return levels.select("key", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def random_number(id_col: Column, seed: str) -> Column:
    """Between 0 and 1, neither of them, from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def _stop(fits: DataFrame, state: DataFrame, attach) -> DataFrame:
    """(key, cut, gap) after one round: how far in the order of ranks each source gets.

    ``fits`` holds the rows that can be taken, with gap. All rows up to the new cut are taken.
    """
    none = F.lit(None).cast("double")
    total = fits.groupBy("key").agg(F.sum("size").alias("total"))
    reached = total.select("key", F.lit(0).cast("long").alias("sum"), none.alias("last"))
    for cells in CELLS:
        cell = F.floor(F.col("rank") * cells)
        sums = fits.groupBy("key", "gap", cell.alias("cell")).agg(
            F.sum("size").alias("size"), F.max("rank").alias("top")
        )
        before = (
            Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        )
        full = (
            attach(sums, reached)
            .withColumn("sum", F.col("sum") + F.coalesce(F.sum("size").over(before), F.lit(0)))
            .withColumn("last", F.coalesce(F.max("top").over(before), F.col("last")))
            .where(F.col("sum") + F.col("size") > F.col("gap"))
            .groupBy("key")
            .agg(F.min(F.struct("cell", "sum", "last")).alias("x"))
        )
        reached = pin(full.select("key", "x.cell", "x.sum", "x.last"))
        fits = attach(fits, reached.select("key", "cell")).where(cell == F.col("cell")).drop("cell")
        reached = reached.drop("cell")
    upto = Window.partitionBy("key").orderBy("rank")
    exact = (
        attach(fits, reached)
        .withColumn("sum", F.col("sum") + F.sum("size").over(upto))
        .where(F.col("sum") <= F.col("gap"))
        .groupBy("key")
        .agg(F.max("sum").alias("exact_sum"), F.max("rank").alias("exact_last"))
    )
    return (
        state.join(total, "key", "left")
        .join(reached, "key", "left")
        .join(exact, "key", "left")
        .select(
            "key",
            # a source that no cell fills takes all that fits
            F.when(F.col("sum").isNull(), F.lit(1.0))
            .otherwise(F.coalesce("exact_last", "last", "cut"))
            .alias("cut"),
            (
                F.col("gap")
                - F.when(F.col("sum").isNull(), F.coalesce("total", F.lit(0)))
                .otherwise(F.coalesce("exact_sum", "sum"))
            ).alias("gap"),
        )
    )


def mix(
    df: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    weight_col: str | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    rounds: int = ROUNDS,
    seed: str = SEED,
) -> DataFrame:
    """``df`` with size, source_size, target, copies and taken (words: copies times size)."""
    if share > cap:
        raise ValueError("the sources cannot give more than cap times their words")
    own_weight = F.lit(1.0) if weight_col is None else F.col(f"`{weight_col}`").cast("double")

    def described(frame: DataFrame) -> DataFrame:
        return frame.select(
            source_key(source_col).alias("key"),
            word_count(text_col).alias("size"),
            random_number(F.col(f"`{id_col}`"), seed).alias("u"),
            F.coalesce(own_weight, F.lit(0.0)).alias("own"),
        )

    narrow = pin(described(df))
    sums = pin(
        narrow.groupBy("key").agg(
            F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("own")).alias("mass")
        )
    )
    few = sums.count() <= BROADCAST_SOURCES

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right) if few else right, "key")

    targets = source_targets(sums.select("key", "source_size"), weights, share, cap)
    targets = pin(targets.join(sums.select("key", "mass"), "key"))
    expected = F.least(
        F.lit(float(cap)),
        F.coalesce(F.try_divide("target", "mass"), F.lit(0.0)) * F.col("own"),
    )

    def ranked(frame: DataFrame) -> DataFrame:
        p = F.col("expected") - F.col("certain")
        u = F.col("u")
        return (
            frame.withColumn("expected", expected)
            .withColumn("certain", F.floor("expected"))
            # odds of u over odds of p, mapped to 0 ... 1
            .withColumn("rank", F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)))
        )

    rows = ranked(attach(narrow, targets))
    certain = rows.groupBy("key").agg(F.sum(F.col("certain") * F.col("size")).alias("given"))
    state = pin(
        targets.join(certain, "key").select(
            "key", F.lit(-1.0).alias("cut"), (F.col("target") - F.col("given")).alias("gap")
        )
    )
    rows = rows.where(F.col("rank").isNotNull()).select("key", "size", "rank")
    steps = []
    for _ in range(rounds):
        fits = attach(rows, state).where(
            (F.col("rank") > F.col("cut")) & (F.col("size") <= F.col("gap"))
        )
        after = pin(_stop(fits.select("key", "size", "rank", "gap"), state, attach))
        steps.append(
            state.join(after.select("key", F.col("cut").alias("stop")), "key").select(
                "key", F.struct("cut", "stop", "gap").alias("step")
            )
        )
        state = after
    decided = targets
    for i, step in enumerate(steps):
        decided = decided.join(step.withColumnRenamed("step", f"step{i}"), "key")
    decided = pin(
        decided.select(
            "key", "source_size", "target", "mass",
            F.array(*(f"step{i}" for i in range(rounds))).alias("steps"),
        )
    )

    # each row reads its decision from its source's steps; helper columns live in one struct
    keyed = df.withColumn("__llm_key", source_key(source_col)).withColumn(
        "__llm_row",
        F.struct(
            word_count(text_col).alias("size"),
            random_number(F.col(f"`{id_col}`"), seed).alias("u"),
            F.coalesce(own_weight, F.lit(0.0)).alias("own"),
        ),
    )
    sides = decided.select(
        F.col("key").alias("__llm_key"), F.struct(*decided.columns).alias("__llm_source")
    )
    joined = keyed.join(F.broadcast(sides) if few else sides, "__llm_key")
    return _decided(joined, cap).drop("__llm_key", "__llm_row", "__llm_source")


def _decided(joined: DataFrame, cap: int) -> DataFrame:
    row, source = F.col("__llm_row"), F.col("__llm_source")
    rate = F.coalesce(F.try_divide(source["target"], source["mass"]), F.lit(0.0))

    def copies(expected: Column) -> Column:
        certain = F.floor(expected)
        p = expected - certain
        u = row["u"]
        rank = F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p))
        drawn = F.exists(
            source["steps"],
            lambda x: (rank > x["cut"]) & (rank <= x["stop"]) & (row["size"] <= x["gap"]),
        )
        return certain + F.when(F.coalesce(drawn, F.lit(False)), 1).otherwise(0)

    expected = F.least(F.lit(float(cap)), rate * row["own"])
    return (
        joined.withColumn("copies", settled(bind(expected, copies).cast("long")))
        .withColumn("size", row["size"])
        .withColumn("source_size", source["source_size"])
        .withColumn("target", source["target"])
        .withColumn("taken", F.col("copies") * F.col("size"))
    )

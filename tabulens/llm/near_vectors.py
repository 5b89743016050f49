"""Embedding near-dedup by sorted projection passes.

Each pass hashes every vector to 64 signs of random projections, orders all vectors by these bits
as one word (so that vectors with a long common prefix stand together), and compares each with its
``window`` neighbours by cosine in double precision. Pairs at or above the threshold are links;
the links of all passes are united into components.

The number of passes follows the vectors: two vectors at the threshold t agree in a sign with
probability 1 - acos(t) / pi, and to meet in one pass they must share so many signs that no more
than a window of the rows that they are not linked with share them too. How many that are is taken
from a sample: for each sampled vector, its cosines with the others tell how the rows thin out with
every sign, so crowded directions take more passes. There are as many passes as bring the chance to
meet in none below ``miss`` around the most crowded vector of the sample, and at least as many as
spread rows take. Signs are taken from the mean of the sample where that takes fewer passes. Closer
pairs meet sooner. Where passes for a crowd would cost more than comparing the crowd with itself, it is
compared exactly (see crowds.py), beside the passes that the other rows need: 21,000 rows of 64
dimensions with a third at a mutual cosine of 0.85 would take 245 passes without.

The sample only proposes: a crowd that it has no vector of would keep too few passes. So every pass
tells for every vector how many signs bring all that share them into its window, and with that the
chance that a pair around it is missed. Vectors for which the passes together leave more than
``miss`` get more passes, or are compared with all others where that costs less.

Then every component is compared with itself, exactly, in blocks of bounded size: the links that no
window held are counted too, so ``n_links`` is the number of members of the component at or above
the threshold. Only counts leave a block. This grows with the square of a component, as any exact
count of its links does.

How it runs: exact copies are one vector with a count throughout. Passes go in batches, each one
range sort; rows at the edges of partitions are compared in a second, small step. Tasks emit the
links that join parts not joined before, not all pairs.

Defined cases: vectors that are null, empty, zero, without an id, or hold a null or non-finite
component link with nothing; vectors link only with vectors of their length; rows with the same id
are vectors of their own, each with its own links, and equal ones link; extra columns do not matter; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.session import pin

from .crowds import PASS_COST, Ball, core_nodes, crowd_links, links_with_all, plan, unit_rows
from .graph import Forest, components

THRESHOLD = 0.9
WINDOW = 48
MISS = 0.02
SEED = 11
PASSES_PER_JOB = 6
BLOCK = 512
COMPARED = 1024
SAMPLE = 4096


def passes_for(rows: int, threshold: float, window: int, miss: float) -> int:
    """Passes until a pair at the threshold meets in one of them with probability 1 - miss."""
    signs = math.log2(max(rows / window, 2.0))
    meet = (1.0 - math.acos(threshold) / math.pi) ** signs
    return max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def _agree(cosine: np.ndarray) -> np.ndarray:
    """Chance of vectors at a cosine to agree in a random sign."""
    return 1.0 - np.arccos(np.clip(cosine, -1.0, 1.0)) / math.pi


def passes_around(
    unit: np.ndarray, rows: int, centre: np.ndarray, threshold: float, window: int, miss: float
) -> np.ndarray:
    """Passes until a pair around each vector of a sample of ``rows`` meets, for signs from a centre."""
    moved = unit - centre
    norms = np.maximum(np.sqrt((moved * moved).sum(axis=1)), 1e-9)
    moved = moved / norms[:, None]
    needed = np.ones(len(unit))
    for at in range(0, len(unit), BLOCK):
        own = slice(at, at + BLOCK)
        others = unit[own] @ unit.T < threshold
        agree = np.where(others, _agree(moved[own] @ moved.T), 0.0)
        share = rows / len(unit)
        # the fewest signs after which no more than a window of the others is left
        left, signs = agree.copy(), np.ones(len(agree), np.int64)
        for _ in range(63):
            more = left.sum(axis=1) * share > window
            if not more.any():
                break
            left[more] *= agree[more]
            signs += more
        pair = _agree(1.0 - (1.0 - threshold) / norms[own] ** 2)
        meet = np.minimum(np.maximum(pair, 0.5) ** signs, 1.0 - 1e-12)
        needed[own] = np.ceil(math.log(miss) / np.log1p(-meet))
    return needed


def plan_passes(
    classes: DataFrame, threshold: float, window: int, miss: float
) -> tuple[int, dict[int, np.ndarray], list[Ball]]:
    """The number of passes, the centres that signs are taken from by length, and the crowds."""
    counted = classes.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    lengths = {r.length: r.n for r in counted.collect()}
    drawn = (
        classes.orderBy(F.xxhash64(F.lit(SEED), "h1", "h2"), "h1", "h2")
        .limit(SAMPLE)
        .select(F.col("vector").cast("array<double>").alias("vector"))
        .toArrow()["vector"]
        .combine_chunks()
    )
    sizes = drawn.value_lengths().to_numpy(zero_copy_only=False)
    least = passes_for(sum(lengths.values()), threshold, window, miss)
    passes, centres, balls = least, {}, []
    for length in np.unique(sizes):
        unit, rows = unit_rows(drawn.filter(pa.array(sizes == length))), lengths[int(length)]
        planned = []
        for centre in (np.zeros(int(length)), unit.mean(axis=0)):
            needed = passes_around(unit, rows, centre, threshold, window, miss)
            planned.append((*plan(unit, needed, rows, least, threshold), centre))
        _, own, crowds, centres[int(length)] = min(planned, key=lambda p: p[0])
        passes, balls = max(passes, own), balls + crowds
    return passes, centres, balls


def projections(number: int, length: int) -> np.ndarray:
    """The random directions of a pass for vectors of a length."""
    return np.random.default_rng([SEED, number, length]).standard_normal((length, 64))


def vector_classes(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, h1, h2) of every usable row, and one row per distinct vector.

    A class is a 128-bit digest of the vector: (h1, h2, node, least, vector, copies), where ``node`` is
    a number of its own once the classes are pinned, and ``least`` the smallest id.
    """
    vector = F.col(f"`{vector_col}`")
    # nan and infinities times 0 are not 0
    usable = (
        F.col(f"`{id_col}`").isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & (x * 0 == 0))
        & F.exists(vector, lambda x: x != 0)
    )
    rows = df.where(F.coalesce(usable, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.xxhash64(vector).alias("h1"),
        F.xxhash64(F.lit(1), vector).alias("h2"),
        vector.alias("vector"),
    )
    classes = rows.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"),
        F.any_value("vector").alias("vector"),
        F.count("*").alias("copies"),
    )
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    return rows.select("vec_id", "h1", "h2"), classes


def _order_rows(
    batches: Iterator[pa.RecordBatch], numbers: list[int], centres: dict[int, np.ndarray]
) -> Iterator[pa.RecordBatch]:
    """(pass, length, bits, h1, node, vector) of each vector and pass."""
    for batch in batches:
        lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            part = batch.filter(pa.array(lengths == length))
            unit = unit_rows(part.column("vector")) - centres.get(int(length), 0.0)
            for number in numbers:
                signs = np.packbits(unit @ projections(number, int(length)) > 0, axis=1)
                # big-endian words keep the order of the bits; the sign bit is shifted for longs
                words = signs.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), number, np.int32)),
                        pa.array(np.full(len(part), length, np.int32)),
                        pa.array(words.view(np.int64)),
                        part.column("h1"),
                        part.column("node"),
                        part.column("vector"),
                    ],
                    names=["pass", "length", "bits", "h1", "node", "vector"],
                )


def _neighbours(unit: np.ndarray, fresh: int, window: int, threshold: float):
    """Pairs (i, j), i < j, of rows at most ``window`` apart, j among the last ``fresh`` rows."""
    total = len(unit)
    for start in range(total - fresh, total, window):
        stop = min(start + window, total)
        low = max(0, start - window)
        i, j = np.nonzero(unit[low:stop] @ unit[start:stop].T >= threshold)
        i, j = i + low, j + start
        near = (i < j) & (j - i <= window)
        yield from zip(i[near].tolist(), j[near].tolist(), strict=True)


_LINK = pa.schema(
    [
        ("a", pa.int64()), ("b", pa.int64()), ("seam", pa.int64()), ("side", pa.int32()),
        ("place", pa.int32()), ("pass", pa.int32()), ("length", pa.int32()),
        ("vector", pa.list_(pa.float64())), ("chances", pa.binary()),
    ]
)


def _shared_signs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of leading bits that two words have in common."""
    apart = a.view(np.uint64) ^ b.view(np.uint64)
    high, low = apart >> np.uint64(32), apart & np.uint64(0xFFFFFFFF)
    length = np.where(high > 0, np.frexp(high.astype(float))[1] + 32, np.frexp(low.astype(float))[1])
    return 64 - length


def log_chances(
    bits: np.ndarray, agree: np.ndarray, window: int, open_left: bool, open_right: bool
) -> np.ndarray:
    """Logarithm of the chance that a pair around each row of a sorted run does not meet in it.

    A row meets all that share more signs with it than the first row beyond its window, on either
    side; ``agree`` is the chance of a row and its partner to share a sign. A run may go on beyond an
    open end: there its last row stands for those that are not seen, and shares no fewer signs.
    """
    at = np.arange(len(bits))
    signs = np.zeros(len(bits), np.int64)
    for far, end, is_open in ((at - window - 1, 0, open_left), (at + window + 1, len(bits) - 1, open_right)):
        inside = (far >= 0) & (far < len(bits))
        beyond = _shared_signs(bits, bits[np.clip(far, 0, len(bits) - 1)]) + 1
        signs = np.maximum(signs, np.where(inside | is_open, beyond, 0))
    meet = np.minimum(agree ** np.minimum(signs, 64), 1.0 - 1e-12)
    return np.log1p(-meet)


def _compare_sorted(
    batches: Iterator[pa.RecordBatch],
    window: int,
    threshold: float,
    centres: dict[int, np.ndarray],
) -> Iterator[pa.RecordBatch]:
    """Links within one sorted partition, the rows that the partitions beside it must see, and chances.

    ``chances`` are those of a run, packed: its nodes, and the logarithms of their chances to be missed.
    """
    forest, part = Forest(), TaskContext.get().partitionId()
    run, nodes, unit = None, np.empty(0, np.int64), np.empty((0, 0))
    head: list[dict] = []
    seen: list[tuple[np.ndarray, ...]] = []
    runs = 0

    def chances(last: bool) -> pa.RecordBatch:
        own, bits, agree = (np.concatenate(c) for c in zip(*seen, strict=True))
        missed = log_chances(bits, agree, window, open_left=runs == 1, open_right=last)
        packed = own.astype("<i8").tobytes() + missed.astype("<f4").tobytes()
        return pa.RecordBatch.from_pylist([{"chances": packed}], _LINK)

    def seam(side: int, place: int, node: int, vector: np.ndarray) -> dict:
        return {
            "a": node, "b": None, "seam": part if side else part - 1, "side": side,
            "place": place, "pass": run[0], "length": run[1], "vector": vector.tolist(),
        }

    for batch in batches:
        keys = np.stack(
            [batch.column(k).to_numpy(zero_copy_only=False) for k in ("pass", "length")], axis=1
        )
        cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1), len(keys)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(start, stop, COMPARED):
                own = batch.slice(at, min(COMPARED, stop - at))
                key = (int(keys[at][0]), int(keys[at][1]))
                fresh = unit_rows(own.column("vector"))
                ids = own.column("node").to_numpy(zero_copy_only=False)
                if key != run:
                    if seen:
                        yield chances(last=False)
                    seen, runs = [], runs + 1
                    first_run = run is None
                    run, nodes, unit = key, ids, fresh
                else:
                    first_run = False
                    nodes, unit = np.concatenate([nodes, ids]), np.concatenate([unit, fresh])
                if first_run or (head and len(head) < window and head[0]["pass"] == run[0]
                                 and head[0]["length"] == run[1]):
                    for node, vector in zip(ids, fresh, strict=True):
                        if len(head) < window:
                            head.append(seam(0, len(head), int(node), vector))
                moved = fresh - centres.get(key[1], 0.0)
                apart = np.maximum((moved * moved).sum(axis=1), 1e-18)
                agree = np.maximum(_agree(1.0 - (1.0 - threshold) / apart), 0.5)
                seen.append((ids, own.column("bits").to_numpy() ^ np.int64(-(2**63)), agree))
                found = [
                    {"a": int(nodes[i]), "b": int(nodes[j])}
                    for i, j in _neighbours(unit, len(ids), window, threshold)
                    if forest.join(int(nodes[i]), int(nodes[j]))
                ]
                if found:
                    yield pa.RecordBatch.from_pylist(found, _LINK)
                nodes, unit = nodes[-window:], unit[-window:]
    if run is not None:
        yield chances(last=True)
        tail = [
            seam(1, i, int(n), v)
            for i, (n, v) in enumerate(zip(nodes[::-1], unit[::-1], strict=True))
        ]
        yield pa.RecordBatch.from_pylist(head + tail, _LINK)


def _compare_seam(rows: pa.Table, window: int, threshold: float) -> pa.Table:
    """Links between the last rows of a partition and the first ones of the next."""
    found = []
    sides = [rows.filter(pc.equal(rows["side"], s)) for s in (0, 1)]
    if all(len(s) for s in sides) and all(
        sides[0][k][0].as_py() == sides[1][k][0].as_py() for k in ("pass", "length")
    ):
        after, before = (s.sort_by("place") for s in sides)
        near = unit_rows(before["vector"]) @ unit_rows(after["vector"]).T >= threshold
        for i, j in zip(*np.nonzero(near), strict=True):
            if i + j < window:  # i + j + 1 places apart
                found.append({"a": before["a"][int(i)].as_py(), "b": after["a"][int(j)].as_py()})
    return pa.Table.from_pylist(found, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _unpack_chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, missed) of every row of the packed runs."""
    for batch in batches:
        for packed in batch.column("chances").to_pylist():
            number = len(packed) // 12
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(packed, "<i8", number)),
                    pa.array(np.frombuffer(packed, "<f4", number, 8 * number).astype(np.float64)),
                ],
                names=["node", "missed"],
            )


def window_links(
    classes: DataFrame,
    passes: range,
    window: int = WINDOW,
    threshold: float = THRESHOLD,
    centres: dict[int, np.ndarray] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(a, b): links that together join all vectors that any of the passes found to be near.

    And (node, missed), the logarithm of the chance that a pair around the vector was missed, a row
    for each pass and vector.
    """
    spark = classes.sparkSession
    kind = classes.schema["vector"].dataType.simpleString()
    links = spark.createDataFrame([], "a long, b long")
    missed = spark.createDataFrame([], "node long, missed double")
    for start in range(passes.start, passes.stop, PASSES_PER_JOB):
        numbers = list(range(start, min(start + PASSES_PER_JOB, passes.stop)))
        ordered = classes.select("h1", "node", "vector").mapInArrow(
            lambda batches, numbers=numbers: _order_rows(batches, numbers, centres or {}),
            f"pass int, length int, bits long, h1 long, node long, vector {kind}",
        )
        place = ["pass", "length", "bits", "h1"]
        compared = pin(
            ordered.repartitionByRange(*place)
            .sortWithinPartitions(*place)
            .mapInArrow(
                lambda batches: _compare_sorted(batches, window, threshold, centres or {}),
                "a long, b long, seam long, side int, place int, pass int, length int, "
                "vector array<double>, chances binary",
            )
        )
        seams = (
            compared.where(F.col("seam").isNotNull())
            .drop("chances")
            .groupBy("seam")
            .applyInArrow(lambda rows: _compare_seam(rows, window, threshold), "a long, b long")
        )
        links = links.union(compared.where(F.col("b").isNotNull()).select("a", "b")).union(seams)
        missed = missed.union(
            compared.where(F.col("chances").isNotNull())
            .select("chances")
            .mapInArrow(_unpack_chances, "node long, missed double")
        )
    return links.distinct(), missed


def more_passes(short: dict[int, int], rows: int) -> int:
    """How many more passes cost least, with all rows that they do not suffice for compared with all.

    ``short`` tells how many rows need how many more passes.
    """

    def cost(number: int) -> int:
        return rows * (number * PASS_COST + sum(n for k, n in short.items() if k > number))

    return min([0, *short], key=cost)


def whole_links(
    classes: DataFrame, threshold: float, window: int, miss: float
) -> DataFrame:
    """(a, b): links of the planned passes and crowds, and of what these left too likely to be missed.

    The plan comes from a sample. Each pass then tells for every vector how likely a pair around it is
    missed; where the passes together leave more than ``miss``, there are more passes, or the vector
    is compared with all others where that costs less.
    """
    passes, centres, balls = plan_passes(classes, threshold, window, miss)
    links = crowd_links(classes, balls, threshold)
    done = pin(core_nodes(classes, balls, threshold)) if balls else None
    rows, first, missed = classes.count(), 0, None
    while passes > first:
        found, own = window_links(classes, range(first, passes), window, threshold, centres)
        links, first = links.union(found), passes
        own = own if missed is None else own.union(missed)
        missed = pin(own.groupBy("node").agg(F.sum("missed").alias("missed")))
        short = missed.where(F.col("missed") > math.log(miss))
        # as many more at the rate of the passes so far, rounded up to a power of 1.25
        need = passes * (F.lit(math.log(miss)) / F.least("missed", F.lit(-1e-12)) - 1.0)
        step = F.ceil(F.log(F.greatest(need, F.lit(1.0))) / math.log(1.25))
        short = short.withColumn("need", F.ceil(F.pow(F.lit(1.25), step)).cast("long"))
        if done is not None:
            short = short.join(done, "node", "left_anti")
        short = pin(short.select("node", "need"))
        counted = {r.need: r.n for r in short.groupBy("need").agg(F.count("*").alias("n")).collect()}
        more = more_passes(counted, rows)
        if any(k > more for k in counted):
            alone = short.where(F.col("need") > more).select("node")
            links = links.union(links_with_all(classes, alone, threshold))
            done = alone if done is None else done.union(alone)
        passes += more
    return links


def _count_blocks(
    batches: Iterator[pa.RecordBatch], threshold: float
) -> Iterator[pa.RecordBatch]:
    """(node, links): links of each vector inside one pair of blocks, weighted by copies."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])
    held: list[pa.RecordBatch] = []
    key = None

    def counted() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        unit = unit_rows(rows["vector"])
        copies = rows["copies"].to_numpy()
        block = rows["block"].to_numpy()
        near = unit @ unit.T >= threshold
        np.fill_diagonal(near, False)
        if key[1] != key[2]:  # pairs inside one block are another group's
            near &= block[:, None] != block[None, :]
        return pa.RecordBatch.from_arrays(
            [rows["node"].combine_chunks(), pa.array((near @ copies).astype(np.int64))],
            schema=schema,
        )

    for batch in batches:
        keys = np.stack(
            [batch.column(k).to_numpy(zero_copy_only=False) for k in ("component", "i", "j")],
            axis=1,
        )
        cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1), len(keys)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if stop == start:
                continue
            if key is not None and key != tuple(keys[start]):
                yield counted()
                held = []
            key = tuple(keys[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield counted()


def component_links(
    classes: DataFrame, member: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(node, links): for each distinct vector the rows in its component that it links with."""
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / block).cast("int")
    rows = (
        classes.join(member, "node")
        .join(sizes, "component")
        .select(
            "component", "node", "copies", F.col("vector").cast("array<double>").alias("vector"),
            F.pmod(F.xxhash64("node"), parts).cast("int").alias("block"), parts.alias("parts"),
        )
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "component", "node", "copies", "vector", "block",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )
    return (
        rows.repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInArrow(lambda batches: _count_blocks(batches, threshold), "node long, links long")
        .groupBy("node")
        .agg(F.sum("links").alias("links"))
    )


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    window: int = WINDOW,
    miss: float = MISS,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    rows, found = vector_classes(df, id_col, vector_col)
    classes = pin(found)
    member = pin(components(whole_links(classes, threshold, window, miss)))
    counts = component_links(classes, member, threshold)
    named = (
        classes.select("node", "least")
        .join(member, "node")
        .groupBy("component")
        .agg(F.min("least").alias("component_id"))
    )
    member = member.join(named, "component").select("node", "component_id")
    facts = (
        classes.select("h1", "h2", "node", "least", "copies")
        .join(member, "node", "left")
        .join(counts, "node", "left")
        .select(
            "h1",
            "h2",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    usable = rows.join(facts, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    vector = F.col(f"`{vector_col}`")
    others = df.where(
        ~F.coalesce(
            F.col(f"`{id_col}`").isNotNull()
            & F.forall(vector, lambda x: x.isNotNull() & (x * 0 == 0))
            & F.exists(vector, lambda x: x != 0),
            F.lit(False),
        )
    ).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.col(f"`{id_col}`").cast("long").alias("component_id"),
    )
    return usable.unionByName(others).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )

"""MinHash near-dedup of texts as bags of word shingles (BagMinHash).

A text is the multiset of its five-word shingles in lower case; two texts are near when their
weighted Jaccard (sum of the smaller counts over sum of the larger) reaches the threshold.

Signatures. Every shingle carries Poisson processes over (time, weight): one for each dyadic part
[0, 1), [1, 2), [2, 4) ... of the weight axis, with a rate as long as the part. A point has a time, a
weight inside the part and one of ``registers`` registers; it counts when its weight is below the
shingle's count. A register keeps the earliest time. Equal registers of two texts have the
probability of the weighted Jaccard, without bias. Points come in order of time, so a process ends
as soon as it is later than all registers of its text: the cost is about the number of shingles
plus registers * log(registers), whatever the counts. All texts of a slice advance together.

Candidates. Registers are banded; texts that share a band are tied to the first one of the bucket,
and the ties' connected components are clusters that hold every candidate pair.

Verification. Inside a cluster all pairs are compared exactly: clusters up to a block in one group;
larger ones are split by classes of length (near texts are at most one class apart) and blocks in a
class, and pairs of blocks are groups (clusters.py). A group counts overlaps as products of 0/1
matrices over (shingle, occurrence) and emits only links that join what was apart. Components of the links are
the near-duplicate classes.

How it runs: one pass over the texts leaves ids, digests and band keys (written to the checkpoint
folder); exact copies are one class from there on; texts move once more, and only those of clusters
are grouped. Buckets are reduced to their first member before the shuffle. No pairs are listed.

Defined cases: null and empty texts, and texts without words, are near to nothing and kept; a text
of fewer than five words is one shingle, so it matches copies alone; among copies the smallest id
stays, a null id last; of rows that agree in id and text one stays; extra columns are kept, helper
columns have names of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.session import pin

from .clusters import across, block_groups, each_group, near_matrix, overlaps
from .graph import Forest, components
from .shingles import (
    WIDTH,
    WordHashes,
    find_words,
    scramble,
    shingle_hashes,
    slices,
    text_slices,
)
from .texts import whole

THRESHOLD = 0.8
BANDS = 32
ROWS = 8

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(
    hashes: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of the distinct shingles of each text, in order."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    places = np.nonzero(first)[0]
    weights = np.diff(np.append(places, len(row)))
    return row[places], hashes[places], weights


def signatures(
    row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int
) -> np.ndarray:
    """The earliest times of every register, one line per text (infinite without shingles)."""
    times = np.full(texts * registers, np.inf)
    # parts of the weight axis: part k > 0 is [2 ** (k - 1), 2 ** k)
    parts = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(row)), parts)
    part = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(part > 0, 2 ** np.maximum(part - 1, 0), 0)
    rate = np.where(part > 0, low, 1).astype(np.float64)
    owner, limit = row[item], weight[item] - low
    state = scramble(shingle[item] + part.astype(np.uint64) * _GOLDEN)
    clock = np.zeros(len(item))
    while len(owner):
        state = scramble(state + _GOLDEN)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        clock = clock - np.log(uniform) / rate
        more = scramble(state ^ _GOLDEN)
        register = (more % np.uint64(registers)).astype(np.int64)
        level = ((more >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64)
        hit = level < limit
        np.minimum.at(times, owner[hit] * registers + register[hit], clock[hit])
        latest = times.reshape(texts, registers).max(axis=1)
        alive = clock < latest[owner]
        owner, limit, rate = owner[alive], limit[alive], rate[alive]
        state, clock = state[alive], clock[alive]
    return times.reshape(texts, registers)


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per text and band."""
    bits = times.view(np.uint64).reshape(len(times), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, bits.shape[:2])
    for i in range(rows):
        key = scramble(key ^ bits[:, :, i])
    return key.view(np.int64)


def _describe(
    batches: Iterator[pa.RecordBatch], bands: int, rows: int, width: int
) -> Iterator[pa.RecordBatch]:
    """Id, text digest, class digest, number of shingles and band keys of each text."""
    word_hashes = WordHashes()
    for batch in batches:
        for a, b, texts in text_slices(batch.column("text")):
            words = [find_words(t.lower()) for t in texts]
            counts = np.fromiter(map(len, words), np.int64, b - a)
            digests = [xxhash.xxh128_digest(" ".join(w)) for w in words]
            flat = word_hashes([w for own in words for w in own])
            hashes, sizes = shingle_hashes(flat, counts, width)
            times = signatures(*bags(hashes, sizes), b - a, bands * rows)
            keys = band_keys(times, bands, rows)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            offsets = pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32))
            own = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [
                    own.column("id"), own.column("digest"), pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]), pa.array(sizes.astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                ],
                names=["id", "digest", "h1", "h2", "shingles", "bands"],
            )


def _elements(
    texts: list[str], width: int, word_hashes: WordHashes
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, element) of all texts and the number of elements of each.

    A shingle that occurs n times is n elements, so overlaps of bags are those of sets.
    """
    flats, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in slices([len(t) for t in texts]):
        words = [find_words(t.lower()) for t in texts[a:b]]
        counts = np.fromiter(map(len, words), np.int64, b - a)
        hashes, own = shingle_hashes(word_hashes([w for x in words for w in x]), counts, width)
        flats.append(hashes)
        sizes.append(own)
    size = np.concatenate(sizes)
    row, shingle, weight = bags(np.concatenate(flats), size)
    again = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    element = scramble(np.repeat(shingle, weight) + again.astype(np.uint64) * _GOLDEN)
    return np.repeat(row, weight), element, size


def _links(
    batches: Iterator[pa.RecordBatch], threshold: float, width: int
) -> Iterator[pa.RecordBatch]:
    """(a, b): exact links of each group, as many as join what was apart."""
    word_hashes = WordHashes()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(rows: pa.Table) -> pa.RecordBatch:
        nodes = rows["node"].to_pylist()
        owner, element, size = _elements(rows["text"].to_pylist(), width, word_hashes)
        overlap = overlaps(owner, element, len(nodes))
        near = near_matrix(overlap, size, threshold, across(rows))
        forest = Forest()
        links = [
            {"a": nodes[i], "b": nodes[j]}
            for i, j in zip(*np.nonzero(np.triu(near)), strict=True)
            if nodes[i] != nodes[j] and forest.join(nodes[i], nodes[j])
        ]
        return pa.RecordBatch.from_pylist(links, schema)

    return each_group(batches, compare)


def describe(
    df: DataFrame, id_col: str, text_col: str, bands: int, rows: int, width: int
) -> DataFrame:
    """The narrow table: one row per text with a number of its own (``node``)."""
    kind = df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    narrow = df.select(
        F.col(f"`{id_col}`").alias("id"), text_digest(text_col).alias("digest"),
        whole(text_col).alias("text"),
    ).mapInArrow(
        lambda batches: _describe(batches, bands, rows, width),
        f"id {kind}, digest long, h1 long, h2 long, shingles long, bands array<long>",
    )
    # numbers follow the partitions and order of what is written, so they stay
    return pin(narrow).withColumn("node", F.monotonically_increasing_id())


def text_digest(text_col: str):
    return F.xxhash64(whole(text_col))


def near_classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    width: int = WIDTH,
) -> DataFrame:
    """(id, digest, component_id, kept) of every row; digest is xxhash64 of the text.

    ``component_id`` is the smallest id of the near-duplicate class; one row of it is kept.
    """
    texts = describe(df, id_col, text_col, bands, rows, width)
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("node"))
    classes = pin(
        texts.where(F.col("shingles") > 0)
        .groupBy("h1", "h2")
        .agg(
            F.min(order).alias("first"),
            F.any_value("shingles").alias("shingles"),
            F.any_value("bands").alias("bands"),
        )
        .select("h1", "h2", "first", F.col("first.node").alias("node"), "shingles", "bands")
    )
    keys = classes.select("node", F.explode("bands").alias("key"))
    leads = (
        keys.groupBy("key")
        .agg(F.min("node").alias("lead"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("key", "lead")
    )
    ties = keys.join(leads, "key").where(F.col("node") != F.col("lead"))
    cluster = pin(components(ties.select(F.col("node").alias("a"), F.col("lead").alias("b"))))
    links = pin(_verified(df, classes, texts, cluster, id_col, text_col, threshold, width))
    member = components(links)
    grouped = (
        classes.select("h1", "h2", "first", "node")
        .join(member, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    firsts = grouped.groupBy("component").agg(F.min("first").alias("best"))
    decided = grouped.join(firsts, "component").select("h1", "h2", "best")
    return (
        texts.join(decided, ["h1", "h2"], "left")
        .select(
            "id",
            "digest",
            F.when(F.col("best").isNull(), F.col("id"))
            .otherwise(F.col("best.id"))
            .alias("component_id"),
            F.coalesce(F.col("best.node") == F.col("node"), F.lit(True)).alias("kept"),
        )
    )


def _verified(
    df: DataFrame,
    classes: DataFrame,
    texts: DataFrame,
    cluster: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float,
    width: int,
) -> DataFrame:
    """(a, b): exact links between the texts of each cluster."""
    member = classes.select("node", F.col("shingles").alias("size")).join(cluster, "node")
    groups = block_groups(member, threshold)
    where = texts.select("node", "id", "digest").join(groups, "node")
    source = df.select(
        F.col(f"`{id_col}`").alias("id"), text_digest(text_col).alias("digest"),
        whole(text_col).alias("text"),
    )
    rows = (
        source.alias("d")
        .join(
            where.alias("w"),
            F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.digest") == F.col("w.digest")),
        )
        .select("cluster", "node", "text", F.explode("groups").alias("g"))
        .select("cluster", "g.i", "g.j", "g.part", "node", "text")
    )
    return (
        rows.repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j", "node")
        .mapInArrow(lambda batches: _links(batches, threshold, width), "a long, b long")
        .distinct()
    )


def dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings
) -> DataFrame:
    """The rows of ``df`` that stay: one of each near-duplicate class."""

    def keyed(frame: DataFrame, ident: str) -> DataFrame:
        key = F.xxhash64(F.col(f"`{ident}`"), F.col("__llm_digest"))
        return frame.withColumn("__llm_key", key)

    stay = near_classes(df, id_col, text_col, **settings).where("kept")
    stay = keyed(stay.select("id", F.col("digest").alias("__llm_digest")), "id").drop("id")
    marked = keyed(df.withColumn("__llm_digest", text_digest(text_col)), id_col)
    keys = ["__llm_key", "__llm_digest"]
    # repeated rows stand in one partition after the join
    return marked.join(stay, keys, "left_semi").dropDuplicates(keys).drop(*keys)

"""Near-duplicate operators against brute force."""

import random
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pytest

from tabulens.llm import clusters, graph, line_dedup
from tabulens.llm.bag_minhash import bags, dedup, near_classes, signatures
from tabulens.llm.crowds import crowd_links, plan
from tabulens.llm.graph import Forest, components
from tabulens.llm.line_dedup import dedup_lines
from tabulens.llm import near_vectors as near_vectors_module
from tabulens.llm.near_vectors import (
    log_chances,
    more_passes,
    near_vectors,
    passes_around,
    passes_for,
)
from tabulens.llm.shingles import scramble, shingle_hashes
from tabulens.llm.store import setting

from . import brute
from .conftest import edited, make_text


@pytest.mark.parametrize("block", [256, 4])
def test_near_classes(copies, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    texts = {r.doc_id: r.text for r in copies.collect()}
    want = brute.near_components(texts)
    got = {r.id: r for r in near_classes(copies).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == set(want.values())
    assert {r.doc_id for r in dedup(copies).collect()} == set(want.values())


def test_signatures_estimate_the_weighted_jaccard():
    draw = np.random.default_rng(3)
    shingle = scramble(np.arange(60, dtype=np.uint64))
    a, b = draw.integers(0, 9, 60), draw.integers(0, 9, 60)
    row = np.repeat([0, 1], 60)
    weight = np.concatenate([a, b])
    there = weight > 0
    times = signatures(
        row[there], np.tile(shingle, 2)[there], weight[there], 2, registers=4096
    )
    jaccard = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((times[0] == times[1]).mean() - jaccard) < 0.03


def test_bags_count_repeats():
    hashes = np.array([5, 7, 5, 9], np.uint64)
    row, shingle, weight = bags(hashes, np.array([3, 1]))
    assert row.tolist() == [0, 0, 1]
    assert shingle.tolist() == [5, 7, 9]
    assert weight.tolist() == [2, 1, 1]


@pytest.mark.parametrize("block,run,small", [(256, 512, 10**6), (3, 4, 0)])
def test_line_dedup(spark, monkeypatch, block, run, small):
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "RUN", run)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", small)
    lines = [make_text(i, 40).replace("\n", " ") for i in range(30)]
    texts = {}
    for i in range(40):
        own = [lines[(i * 7 + k) % 30] for k in range(4)]
        own = [edited(x, i, n) for n, x in enumerate(own)] + ["", "Short line", "short  LINE"]
        texts[i] = "\n".join(own)
    want = brute.dedup_lines(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed, r.n_links) for r in dedup_lines(frame).collect()}
    assert got == want


def test_texts_stay_where_they_are_in_several_rounds(spark, monkeypatch):
    lines = [make_text(i, 30).replace("\n", " ") for i in range(20)]
    texts = {i: "\n".join(edited(lines[(i + k) % 20], i, k) for k in range(3)) for i in range(40)}
    want = brute.dedup_lines(texts)
    frame = spark.createDataFrame(
        [*texts.items(), *list(texts.items())[:5]], "doc_id long, text string"
    ).repartition(4)
    bytes_of_all = 40 * line_dedup.PACKED_ROW
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bytes_of_all // 4)
    rounds = []
    plain = line_dedup._pack_rounds
    monkeypatch.setattr(
        line_dedup, "_pack_rounds", lambda *a: (rounds.append(a[1]), plain(*a))[1]
    )
    frame = frame.localCheckpoint()
    out = dedup_lines(frame)
    assert len(rounds) == 2 and min(rounds) > 1
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 45
    assert {r.doc_id: (r.text, r.n_removed, r.n_links) for r in rows} == want


def test_packed_lines_of_documents():
    rows = pa.table(
        {
            "key": pa.array([7, -3, 5]), "check": pa.array([1, 2, 3], pa.int32()),
            "links": pa.array([0, 70_000, 2]),
            "lines": pa.array([[], [300, 0], [1]], pa.list_(pa.int32())),
        }
    )
    found = line_dedup.Packed.of(rows).find(np.array([5, 6, -3, 7, 7]), np.array([3, 3, 2, 1, 2]))
    assert found.to_pylist() == [
        {"links": 2, "lines": [1]}, None, {"links": 70_000, "lines": [300, 0]},
        {"links": 0, "lines": []}, None,
    ]
    assert line_dedup.Packed.of(pa.concat_tables([rows, rows])) is None
    assert line_dedup.Packed.of(rows.slice(0, 0)).find(np.array([5]), np.array([3])).to_pylist() == [None]


def test_long_runs_of_postings_lose_nothing(spark, monkeypatch):
    # one base line and many variants of it: all share their common tokens
    monkeypatch.setattr(line_dedup, "RUN", 8)
    base = make_text(77, 60).replace("\n", " ")
    texts = {i: edited(base, i, i % 3) for i in range(120)}
    want = brute.dedup_lines(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_removed, r.n_links) for r in dedup_lines(frame).collect()}
    assert got == want


def test_near_vectors(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((150, 16))
    rows = [base, base[:40] + 0.2 * draw.standard_normal((40, 16)), base[:10]]
    rows.append(base[0] + 0.15 * draw.standard_normal((60, 16)))
    x = np.concatenate(rows)
    ids = np.arange(len(x)) * 3
    frame = spark.createDataFrame(
        [(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"
    ).repartition(7)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    pairs = [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near))]
    want = brute.components(ids.tolist(), pairs)
    got = {r.vec_id: r for r in near_vectors(frame).collect()}
    links = {i: r.n_links for i, r in got.items()}
    found = sum(links.values()) / near.sum()
    assert found >= 0.97
    assert all(links[int(i)] <= n for i, n in zip(ids, near.sum(axis=1)))
    assert np.mean([got[i].component_id == want[i] for i in want]) >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_vectors_in_a_crowded_direction(spark):
    # half of the rows have a cosine of about 0.8 with each other, below the threshold
    draw = np.random.default_rng(8)
    x = draw.standard_normal((1000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:500] = np.sqrt(0.2) * x[:500] + np.sqrt(0.8) * np.eye(32)[0]
    near = x[:150] + 0.06 * draw.standard_normal((150, 32))
    x = np.concatenate([x, near])
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"
    )
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r.n_links for r in near_vectors(frame, window=8).collect()}
    assert sum(got.values()) >= 0.98 * linked.sum()
    alone = (linked.sum(axis=1) == 1).nonzero()[0]
    assert len(alone) > 50
    assert np.mean([got[int(i)] == 1 for i in alone]) >= 0.97


def test_crowds_that_the_sample_misses_keep_their_links(spark, monkeypatch):
    # 1,650 rows at a mutual cosine of 0.83, 150 pairs of them at 0.905; a sample of 8 sees no crowd
    monkeypatch.setattr(near_vectors_module, "SAMPLE", 8)
    draw = np.random.default_rng(21)
    x = draw.standard_normal((6000, 128))
    x[:1650, 0] = 0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x[1500:1650] - (x[1500:1650] * x[:150]).sum(axis=1)[:, None] * x[:150]
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    x[1500:1650] = 0.44 * x[:150] + np.sqrt(1 - 0.44**2) * turned
    x[:1650] *= np.sqrt(0.17)
    x[:1650, 0] = np.sqrt(0.83)
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"
    ).repartition(4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    links = {r.vec_id: r.n_links for r in near_vectors(frame).collect()}
    assert linked.sum() >= 300
    assert sum(links.values()) >= 0.98 * linked.sum()


def test_chances_of_a_sorted_run():
    bits = np.array([0, 1, 2, 3, 1 << 62, 1 << 63], np.uint64).view(np.int64)
    agree = np.full(6, 0.9)
    signs = np.log1p(-np.exp(np.log(0.9) * np.arange(65)).clip(max=1 - 1e-12))
    got = log_chances(bits, agree, 1, open_left=False, open_right=False)
    # the first row beyond the window: 2, 3, 0 and 1 << 62, 1 and 1 << 63, 2, 3
    assert got.tolist() == pytest.approx(signs[[63, 63, 63, 63, 2, 1]].tolist())
    got = log_chances(bits, agree, 1, open_left=True, open_right=True)
    assert got[[0, 5]].tolist() == pytest.approx(signs[[64, 64]].tolist())


def test_more_passes_or_all_compared():
    assert more_passes({}, 1000) == 0
    assert more_passes({2: 511}, 1000) == 0
    assert more_passes({2: 100_000}, 1000) == 2
    assert more_passes({2: 100_000, 500: 300}, 1000) == 2


def test_passes_grow_with_the_rows():
    counts = [passes_for(n, 0.9, 48, 0.02) for n in (10, 10**4, 10**6, 10**9)]
    assert counts == sorted(counts) and counts[0] < counts[-1]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    frame = spark.createDataFrame(path + star + [(500, 500)], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_tasks_of_components_follow_the_links(spark, monkeypatch):
    draw = random.Random(3)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    want = brute.components(range(400), pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    frame = spark.createDataFrame(pairs, "a long, b long")
    many = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    context = spark.sparkContext
    tracker = context.statusTracker()
    for links, mean in ((1_000, 32), (10, 48)):  # stages that write nothing may have all 64
        monkeypatch.setattr(graph, "LINKS", links)
        group = f"components-{links}"
        context.setJobGroup(group, group)
        try:
            with ExitStack() as stack:
                for key, value in many.items():
                    stack.enter_context(setting(spark, key, value))
                got = {r.node: r.component for r in components(frame).collect()}
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)
        assert got == {x: want[x] for x in linked}
        jobs = [tracker.getJobInfo(j) for j in sorted(tracker.getJobIdsForGroup(group))]
        stages = sorted({s for j in jobs for s in j.stageIds})
        ran = [x.numTasks for s in stages if (x := tracker.getStageInfo(s)) and x.numCompletedTasks]
        assert ran and sum(ran) / len(ran) <= mean


def test_no_row_functions_and_no_products(copies):
    plan = dedup_lines(copies)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_near_vectors_that_share_an_id(spark):
    near = [[1.0, 0.0], [0.99, 0.01], [0.98, 0.05]]
    rows = [(7, near[0]), (7, [0.0, -1.0]), (8, near[1]), (9, near[2]), (10, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(frame).collect())
    assert got == [(7, 0, 7), (7, 2, 7), (8, 2, 7), (9, 2, 7), (10, 0, 10)]


@pytest.mark.parametrize("block", [4096, 100])
def test_crowds_are_compared_exactly_where_that_is_cheaper(spark, block):
    draw = np.random.default_rng(12)
    x = draw.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:1500] = np.sqrt(0.15) * x[:1500] + np.sqrt(0.85) * np.eye(64)[0]
    x[2900:] = x[:100] + 0.03 * draw.standard_normal((100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    needed = passes_around(x, 10**5, np.zeros(64), 0.9, 48, 0.02)
    least = passes_for(10**5, 0.9, 48, 0.02)
    assert needed[:1500].min() > 10 * least
    _, passes, balls = plan(x, needed, 10**5, least, 0.9)
    assert passes < needed[:1500].min() / 10 and len(balls) == 1
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<double>"
    ).repartition(5)
    links = crowd_links(frame, balls, 0.9, block).collect()
    near = np.triu(x @ x.T >= 0.9, 1)
    core = np.arccos(x @ balls[0].pivot) <= balls[0].angle
    want = [(int(i), int(j)) for i, j in zip(*near.nonzero()) if core[i] or core[j]]
    assert len(want) >= 100
    assert all(near[min(r), max(r)] for r in links)
    ids = list(range(3000))
    assert brute.components(ids, [(r.a, r.b) for r in links]) == brute.components(ids, want)


def test_passes_stay_where_a_crowd_costs_more():
    draw = np.random.default_rng(13)
    x = draw.standard_normal((600, 32))
    x[:300] = 0.4 * x[:300] + 5 * np.eye(32)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    needed = np.where(np.arange(600) < 300, 40.0, 20.0)
    assert plan(x, needed, 10**9, 30, 0.9)[1:] == (40, [])


def _tied(postings, threshold):
    """Components of the ties that a task finds in packed postings, dealt in several batches."""
    batches = []
    for part in np.array_split(np.array(postings, np.int64), 7):
        token, node, size, place = part.T.copy()
        batches += line_dedup._packed(token, node, (size << 32) | place).to_pylist()
    rows = pa.Table.from_pylist(sorted(batches, key=lambda row: row["bucket"]))
    rows = rows.cast(pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("token", "node", "at"))]))
    forest = Forest()
    for batch in line_dedup._ties(iter(rows.to_batches(max_chunksize=3)), threshold):
        for tie in batch.to_pylist():
            forest.join(tie["a"], tie["b"])
    return forest


@pytest.mark.parametrize("held", [2_000_000, 40])
def test_packed_postings_lose_no_candidate(monkeypatch, held):
    """Long runs are thinned while they come, short ones compared pair by pair."""
    monkeypatch.setattr(line_dedup, "RUN", 8)
    monkeypatch.setattr(line_dedup, "HELD", held)
    rng = np.random.default_rng(3)
    tokens = rng.integers(-(2**63), 2**63, 60)
    weights = np.r_[0.4, 0.2, np.full(58, 0.4 / 58)]
    postings = [
        (tokens[rng.choice(60, p=weights)], node, rng.integers(1, 60), 0) for node in range(600)
    ]
    forest = _tied(postings, 0.8)
    for k, (token, node, size, place) in enumerate(postings):
        for other, one, m, at in postings[:k]:
            low, high = min(size, m), max(size, m)
            if token == other and low >= 0.8 * high - 1e-9 and low >= np.ceil(0.8 / 1.8 * (low + high)):
                assert forest.find(node) == forest.find(one)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingle_hashes_word_by_word(width):
    rng = np.random.default_rng(width)
    counts = rng.integers(0, 9, 40)
    words = rng.integers(0, 2**63, counts.sum()).astype(np.uint64)
    want, sizes = [], []
    for own in np.split(words, np.cumsum(counts)[:-1]):
        shingles = [own[k : k + width] for k in range(max(len(own) - width + 1, min(len(own), 1)))]
        sizes.append(len(shingles))
        for shingle in shingles:
            value = np.zeros(1, np.uint64)
            for k, word in enumerate(shingle):
                value = scramble(value ^ word) + np.uint64(k + 1)
            want.append(int(value[0]))
    got, number = shingle_hashes(words, counts, width)
    assert (got.tolist(), number.tolist()) == (want, sizes)


def test_small_groups_are_compared_at_once():
    rng = np.random.default_rng(4)
    group = np.repeat(np.arange(30), rng.integers(1, 13, 30))
    own = [set(rng.integers(0, 9, rng.integers(1, 7)).tolist()) for _ in group]
    line = np.repeat(np.arange(len(own)), [len(x) for x in own])
    token = np.array([t for x in own for t in sorted(x)], np.uint64)
    got = line_dedup._common_in_small(line, token, group, 12)
    want = [
        (a, b, len(own[a] & own[b]))
        for a in range(len(own))
        for b in range(a + 1, len(own))
        if group[a] == group[b] and own[a] & own[b]
    ]
    assert list(zip(*(x.tolist() for x in got), strict=True)) == want


@pytest.mark.parametrize("batch,rows", [(1, 1), (3, 4), (7, 5), (100, 6), (100, 1000)])
def test_several_groups_are_whole_runs(batch, rows):
    rng = np.random.default_rng(6)
    keys = np.repeat(np.array([(c, i, 7) for c in range(6) for i in range(4)]), rng.integers(1, 6, 24), axis=0)
    table = pa.table({k: keys[:, n] for n, k in enumerate(("cluster", "i", "j"))})
    calls = []
    list(clusters.several_groups(
        iter(table.to_batches(max_chunksize=batch)), lambda t, starts: calls.append((t, starts)), rows
    ))
    runs = [t.slice(a, b - a).to_pylist() for t, s in calls for a, b in zip(s[:-1], s[1:], strict=True)]
    assert [row for run in runs for row in run] == table.to_pylist()
    assert len(runs) == 24 and all(row == run[0] for run in runs for row in run)
    assert all(len(t) >= rows for t, _ in calls[:-1])


def test_counts_of_cells_travel_packed():
    """A task's counts are CELL_PARTS rows, not one for every cell it met."""
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 5, (3, 2**line_dedup.CELL_BITS))
    packed = [{"cells": own.astype("<i8").tobytes()} for own in counts]
    parts = list(line_dedup._cell_parts([pa.RecordBatch.from_pylist(packed)]))
    assert sum(len(p) for p in parts) == 3 * line_dedup.CELL_PARTS
    sums = pa.Table.from_batches(line_dedup._cell_sums(parts)).sort_by("part")
    assert (np.frombuffer(b"".join(sums["counts"].to_pylist()), "<i8") == counts.sum(axis=0)).all()


def test_lines_alone_are_not_looked_up(spark):
    """A line that is its class, in no cluster, leaves after the classes are counted."""
    rows = [(i, 1, 0, 100 + i, 7) for i in range(50)]
    rows += [(60, 2, 1, 500, 7), (61, 2, 0, 500, 7), (61, 2, 0, 500, 7), (None, 3, 4, 501, 7)]
    lines = spark.createDataFrame(rows, "id long, digest long, line int, h1 long, h2 long")
    cluster = spark.createDataFrame([(100, 100), (101, 100), (501, 501)], "node long, component long")
    got = [tuple(r) for r in line_dedup._places(lines, cluster.repartition(2)).select(
        "id", "digest", "line", "h1", "h2", "component"
    ).collect()]
    want = [(*rows[0], 100), (*rows[1], 100), (*rows[53], 501)] + [(*r, None) for r in rows[50:53]]
    assert sorted(got, key=str) == sorted(want, key=str)

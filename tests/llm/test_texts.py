"""Operators over single texts against the libraries and plain versions."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tabulens.llm import lm_score, rule_queries
from tabulens.llm.chat import escape, escape_role, format_chats, read_back, unescape, unescape_role
from tabulens.llm.classifier import classify, train
from tabulens.llm.license_scan import TEMPLATES, scan_licenses
from tabulens.llm.lm_score import ADD, MIN, SMOOTH, score_texts
from tabulens.llm.mixing import mix
from tabulens.llm.pieces import ChunkTable, chunks_are_safe, load
from tabulens.llm.quality_rules import judge
from tabulens.llm.queries import QUERIES
from tabulens.llm.text_queries import piece_model

from . import brute
from .conftest import make_text

SF = "/root/testdata/sf0.001"
ODD = st.text(
    st.one_of(
        st.characters(exclude_categories=["Cs"]),
        st.sampled_from(list(" ▁\n\t<|>\\&é日\x00aA.")),
    ),
    max_size=40,
)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_pieces_equal_the_library(text):
    processor = load(piece_model())
    ids, counts = ChunkTable(processor).encode([text, "", text + " " + text])
    want = [processor.encode(t) for t in (text, "", text + " " + text)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("text", ["a ", "a\n ", "a▁", "Hello world. ", " ", "▁", "  ", "a  ", "a b "])
def test_pieces_keep_the_marker_at_the_end(text):
    processor = load(piece_model())
    ids, counts = ChunkTable(processor).encode([text, "a", text])
    want = processor.encode(text)
    assert ids.tolist() == want + processor.encode("a") + want
    assert counts.tolist() == [len(want), len(processor.encode("a")), len(want)]
    assert processor.decode(want) == text.replace("▁", " ")


def test_pieces_table_is_emptied_and_model_is_checked(monkeypatch):
    import tabulens.llm.pieces as pieces

    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 3)
    processor = load(piece_model())
    assert chunks_are_safe(processor)
    table = ChunkTable(processor)
    for text in ("a b c d e", "f g  h", "a b"):
        assert table.encode([text])[0].tolist() == processor.encode(text)


def test_sentencepiece_query(spark):
    processor = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, SF).collect()}
    for doc in docs:
        ids = processor.encode(doc.text)
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids)
        joined = ",".join(map(str, ids)).encode()
        assert row.ids_sha256 == hashlib.sha256(joined).hexdigest()
        decoded = processor.decode(ids).encode()
        assert row.decoded_sha256 == hashlib.sha256(decoded).hexdigest()


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_escapes_are_reversible(text):
    assert "<|" not in escape(text) and unescape(escape(text)) == text
    role = escape_role(text)
    assert "\n" not in role and "<|" not in role and unescape_role(role) == text


def test_chat_order_and_loss(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "<\\|x"),
        (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "assistant", "c"),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = format_chats(frame)
    allowed = {(r.conv_id, r.position): r.allowed for r in formatted.collect()}
    assert allowed == {
        (1, 1): True, (1, 2): True, (1, 3): True, (2, 1): True, (2, 2): False, (3, 1): False,
    }
    got = {r.conv_id: r for r in read_back(formatted).collect()}
    assert got[1].complete and not got[2].valid and not got[3].valid
    assert got[1].loss_sha256 == hashlib.sha256(b"<\\|x").hexdigest()
    said = b"system\ns\nuser\n<|im_end|>\nassistant\n<\\|x\n"
    assert got[1].turns_sha256 == hashlib.sha256(said).hexdigest()


def test_quality_signals(spark, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd_rows.select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(99, "a b c a b c d a b"), (98, "x " * 70)], docs.schema))
    for r in judge(docs).collect():
        got = (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
        )
        assert got == brute.quality(r.text), r.doc_id


def test_quality_rules_keep_clean_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = judge(docs).join(labels, "doc_id").where(~F.col("base_failed"))
    rates = dict(judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert rates[1] > 0.98 and rates.get(0, 0) < 0.02


def test_licenses(spark):
    texts = {
        1: "Some words here.\nReleased under the MIT license!\nMore words follow.",
        2: TEMPLATES["Apache-2.0 header"].replace(". ", ".\n"),
        3: "Released", 4: None, 5: make_text(5), 6: "released under the mit licence of the town hall",
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(frame).collect()}
    assert got[1].license == "MIT" and got[1].license_dice == 1.0
    assert got[2].license == "Apache-2.0 header" and got[2].license_dice == 1.0
    assert [got[i].license for i in (3, 4, 5, 6)] == [None] * 4


def test_licences_of_the_documents_and_other_common_ones(spark):
    want = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 short",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    found = {r.line for r in lines.where("lower(line) rlike 'licen[sc]e'").distinct().collect()}
    assert found == set(want)
    texts = list(want.items()) + [(text, name) for name, text in TEMPLATES.items()]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in scan_licenses(frame).collect()}
    assert [got[i] for i in range(len(texts))] == [name for _, name in texts]


def test_mixing_meets_its_targets(spark):
    rows = [(i, make_text(i, 20 + i % 90), "abc"[i % 7 % 3]) for i in range(700)]
    rows += [(1000, make_text(1000, 5000), "a"), (1001, None, None), (1002, "one two", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mix(frame).select("doc_id", "size", "taken", "source", "target", "source_size").toPandas()
    again = mix(frame.repartition(5)).select("doc_id", "taken").toPandas()
    assert dict(zip(first.doc_id, first.taken)) == dict(zip(again.doc_id, again.taken))
    assert (first.taken <= 2 * first["size"]).all() and (first.target <= 2 * first.source_size).all()
    by = first.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 2).all()
    whole = first.groupby("source", dropna=False).target.first().sum()
    assert abs(whole - 1.5 * first["size"].sum()) < 1e-6 * whole


def test_mixing_by_weight_of_documents(spark):
    rows = [(i, "w " * 10, "a", float(1 + i % 2)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = mix(frame, weight_col="w", share=0.5, cap=2).groupBy("w").agg(F.sum("taken")).collect()
    light, heavy = dict(got)[1.0], dict(got)[2.0]
    assert light + heavy == 10_000 and 1.8 < heavy / light < 2.2


LOWER = {i: i + 32 for i in range(65, 91)}


def plain_scores(texts, held, order=3):
    """(tokens, known, base, score) of each text by a plain backoff scorer; N."""
    tokens = [["<s>", *brute.words((t or "").translate(LOWER)), None] for t in texts]
    counts = [Counter() for _ in range(order + 1)]
    follow = Counter()
    for own, out in zip(tokens, held):
        if not out:
            for n in range(1, order + 1):
                for k in range(max(n - 1, 1), len(own)):
                    gram = tuple(own[k - n + 1 : k + 1])
                    counts[n][gram] += 1
                    follow[gram[:-1]] += 1
    total = sum(counts[1].values())
    base = total + ADD * (len(counts[1]) + 1)

    def chance(history, word):
        if not history:
            return (counts[1][(word,)] + ADD) / base
        below = chance(history[1:], word)
        seen = follow[history]
        if not seen or (len(history) == 2 and counts[2][history] < MIN):
            return below
        k = SMOOTH[len(history)]
        return (counts[len(history) + 1][(*history, word)] + k * below) / (seen + k)

    out = []
    for own in tokens:
        known = sum(counts[1][(w,)] > 0 for w in own[1:])
        plain = sum(math.log10(chance((), w)) for w in own[1:])
        logs = [
            math.log10(chance(tuple(own[max(k - order + 1, 0) : k]), own[k]))
            for k in range(1, len(own))
        ]
        out.append((len(own) - 1, known, plain, sum(logs)))
    return out, total, chance


def check_scores(got, ids, texts, held):
    want, total, _ = plain_scores(texts, held)
    by_id = dict(zip(ids, want))
    for r in got:
        n, known, base, score = by_id[r.id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_scores_of_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows]
    got = score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect()
    assert len(got) == len(rows)
    check_scores(got, [r.doc_id for r in rows], [r.text for r in rows], held)


def test_scores_from_many_small_slices(spark, monkeypatch):
    """Slices, ranges of keys and walkers of a few tokens give what whole ones give."""
    texts = [make_text(i, 90) for i in range(12)] + [make_text(3, 90), make_text(1, 3000), "", None]
    texts += ["A b a B a b", "a b a b"] * 3
    held = [i % 4 == 0 for i in range(len(texts))]
    frame = spark.createDataFrame(list(zip(range(len(texts)), texts, held)), "id long, t string, h boolean")
    monkeypatch.setattr(lm_score, "RANGE_KEYS", 50)

    def small(batches, id_type, own=lm_score._slices):
        lm_score.SLICE_BYTES, lm_score.WALK = 700, 5
        return own(batches, id_type)

    monkeypatch.setattr(lm_score, "_slices", small)
    got = score_texts(frame.repartition(3), F.col("h"), "id", "t").collect()
    assert len(got) == len(texts)
    check_scores(got, range(len(texts)), texts, held)


def test_walkers_of_any_length(spark):
    """The automaton of a slice, walked in pieces of different lengths."""
    texts = [make_text(i, 40) for i in range(30)] * 2
    hashes, counts = lm_score.Reader()(texts)
    vocab, words = np.unique(hashes, return_inverse=True)
    own = lm_score.Slice(vocab, words, counts, np.zeros(len(texts), bool))

    def answers(n, keys, training):
        batch = lm_score._ask(n, 0, keys, training, 3)
        asked = pa.Table.from_batches([batch])
        parts = [
            lm_score._answer(asked.filter(pc.equal(asked["range"], r)))
            for r in sorted(set(asked["range"].to_pylist()))
        ]
        return pa.concat_tables(parts)

    got = pa.concat_tables(
        [answers(1, own.hashes, own.training), answers(2, own.pairs, own.training)]
    )
    place, triples = own.triples(lm_score._totals(got, 2, own.pairs))
    got = pa.concat_tables([got, answers(3, triples, own.training[place])])
    distinct = pc.sum(got.filter(pc.equal(got["n"], 1))["distinct"]).as_py()
    total = len(words) + ADD * (distinct + 1)
    automaton, _ = lm_score.build(own, got, total, len(texts))
    whole_texts = automaton.walk(own.words, own.counts)
    want = [w[3] for w in plain_scores(texts, [False] * len(texts))[0]]
    assert whole_texts == pytest.approx(want, rel=1e-9)
    for piece in (2, 3, 7):
        lm_score.WALK, before = piece, lm_score.WALK
        try:
            assert automaton.walk(own.words, own.counts) == pytest.approx(want, rel=1e-9)
        finally:
            lm_score.WALK = before


def test_contexts_sum_to_one():
    texts = ["a b c a b", "a b d", "b c a b c", "a b c d"] * 4
    _, _, chance = plain_scores(texts, [False] * len(texts))
    for history in ((), ("a",), ("a", "b"), ("<s>", "a"), ("<s>",), ("c", "d")):
        total = sum(chance(history, w) for w in ("a", "b", "c", "d", None, "unseen"))
        assert total == pytest.approx(1.0, abs=1e-12)


def test_n_grams_are_kept_from_a_fixed_count_on(spark):
    # "p q r" stands twice among so many tokens that a share of them would be far above 2
    other = " ".join(f"w{i % 50}" for i in range(5_000))
    texts = ["p q r", "p q r"] + [other] * 1_200
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    probe = [(10_000, "p q r"), (10_001, "r q p")]
    probe = spark.createDataFrame(probe, frame.schema)
    scored = score_texts(frame.union(probe).repartition(4), F.col("doc_id") >= 10_000)
    got = {r.id: r for r in scored.where("id >= 10000").collect()}
    assert got[10_000].train_tokens > 6_000_000
    assert got[10_000].score > got[10_000].base_score + 5
    assert got[10_001].score < got[10_001].base_score + 5


def test_packed_numbers():
    numbers = np.random.default_rng(4).integers(0, 2**64, 1000, np.uint64)
    for own in (numbers, numbers[:0], numbers >> np.uint64(50)):
        assert (lm_score.unpack(lm_score.pack(own)) == own).all()


def test_classifier_separates_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES["op10_quality_classifier"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_classifier_learns_from_a_bounded_sample(spark):
    rows = [(i, "good words here" if i % 2 else "bad *** words", i % 2) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = train(frame, train_rows=100)
    assert model.rows == 100
    got = classify(frame, model).collect()
    assert all(r.predicted == r.label for r in got)


def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    con = duckdb.connect()

    kept = stages["quality_rules"](spark, docs, SF).toPandas()
    con.register("documents", docs.toPandas())
    want = con.execute(rule_queries.RULES_SQL).df()
    assert sorted(kept.doc_id) == sorted(want[want.kept].doc_id)

    lines = stages["line_dedup"](spark, spark.createDataFrame(kept, docs.schema), SF).toPandas()
    plain = brute.dedup_lines(dict(zip(kept.doc_id, kept.text)))
    assert dict(zip(lines.doc_id, lines.text)) == {i: t for i, (t, _, _) in plain.items()}
    assert (lines.n_chars == lines.text.str.len()).all()

    near = stages["near_dedup"](spark, spark.createDataFrame(lines, docs.schema), SF).toPandas()
    classes = brute.near_components(dict(zip(lines.doc_id, lines.text)))
    assert sorted(near.doc_id) == sorted(set(classes.values()))

    mixed = stages["mixing"](spark, spark.createDataFrame(near, docs.schema), SF).toPandas()
    con.unregister("documents")
    con.register("documents", near)
    taken = con.execute(rule_queries.MIX_SQL).df()
    copies = {i: t // s for i, t, s in zip(taken.doc_id, taken.taken, taken["size"]) if s}
    filled = mixed[mixed.doc_id.isin(copies)]
    assert dict(filled.doc_id.value_counts()) == {i: n for i, n in copies.items() if n}

    coded = stages["encoding"](spark, spark.createDataFrame(mixed, docs.schema), SF).toPandas()
    processor = load(piece_model())
    ids = {i: processor.encode(t) for i, t in zip(mixed.doc_id, mixed.text)}
    assert len(coded) == len(mixed) and coded.round_trip.all()
    assert all(list(x) == ids[i] for i, x in zip(coded.doc_id, coded.ids))

    whole = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").toPandas()
    assert sorted(zip(whole.doc_id, whole.n_tokens)) == sorted(zip(coded.doc_id, coded.n_tokens))

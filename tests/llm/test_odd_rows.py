"""Every operator on nulls, empty and long texts, repeated rows, clashing names, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulens.llm.bag_minhash import dedup, near_classes
from tabulens.llm.chat import format_chats, read_back
from tabulens.llm.classifier import Model, classify, train
from tabulens.llm.license_scan import scan_licenses
from tabulens.llm.line_dedup import dedup_lines
from tabulens.llm.lm_score import score_texts
from tabulens.llm.mixing import mix
from tabulens.llm.near_vectors import near_vectors
from tabulens.llm.pieces import decode, encode
from tabulens.llm.quality_rules import judge
from tabulens.llm.text_queries import piece_model


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


NO_MODEL = Model(np.zeros(2**10), 0.0, 0)
# operator -> rows it returns for the twelve odd rows
OPERATORS = {
    "rules": (judge, 12),
    "licenses": (scan_licenses, 12),
    "mixing": (mix, 12),
    "pieces": (lambda d: decode(encode(d, piece_model()), piece_model()), 12),
    "classifier": (lambda d: classify(d, NO_MODEL), 12),
    "lines": (dedup_lines, 12),
    "near": (near_classes, 12),
    # of the repeated rows one, of the two copies of text 3 the one with an id
    "near dedup": (dedup, 9),
    "scores": (lambda d: score_texts(d, held_out()), 12),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd_rows, name):
    operator, rows = OPERATORS[name]
    assert len(operator(odd_rows).collect()) == rows


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(odd_rows, name):
    assert OPERATORS[name][0](odd_rows.where("false")).collect() == []


def test_extra_columns_stay(odd_rows):
    for operator in (judge, scan_licenses, dedup_lines, dedup):
        assert set(odd_rows.columns) <= set(operator(odd_rows).columns)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_return_the_columns(spark, odd_rows, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    out = function(spark, odd_rows, "")
    assert [(f.name, f.dataType) for f in out.schema] == [
        (f.name, f.dataType) for f in odd_rows.schema
    ]
    assert function(spark, odd_rows.where("false"), "").collect() == []
    assert out.count() <= 24


def test_null_text_results(odd_rows):
    def one(frame, column="doc_id"):
        return frame.where(F.col(column) == 2).first()

    rules = one(judge(odd_rows))
    assert (rules.n_words, rules.base_failed, rules.kept) == (0, True, False)
    assert one(encode(odd_rows, piece_model())).ids == []
    assert one(scan_licenses(odd_rows)).license is None
    lines = one(dedup_lines(odd_rows))
    assert (lines.text, lines.n_lines, lines.n_removed) == ("", 0, 0)
    near = one(near_classes(odd_rows), "id")
    assert (near.component_id, near.kept) == (2, True)
    score = one(score_texts(odd_rows, held_out()), "id")
    assert score.n_tokens == 1
    mixed = one(mix(odd_rows))
    assert (mixed.size, mixed.taken) == (0, 0)


def test_vectors_and_turns_without_content(spark):
    rows = [
        (1, [1.0, 0.0], "x"), (2, None, "x"), (3, [], None), (4, [0.0, 0.0], "x"),
        (5, [1.0, None], "x"), (6, [float("nan"), 1.0], "x"), (None, [1.0, 0.0], "x"),
        (7, [1.0, 0.0], "x"), (7, [2.0, 0.0], "x"), (8, [1.0, 0.0, 0.0], "x"),
        (9, [float("inf"), 1.0], "x"), (10, [1e300, 1e300], "x"),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors).collect()}
    assert (1, 2, 1, True) in got and (7, 2, 1, False) in got
    assert {r for r in got if r[0] in (2, 3, 4, 5, 6, 8, 9, 10)} == {
        (i, 0, i, True) for i in (2, 3, 4, 5, 6, 8, 9, 10)
    }
    assert near_vectors(vectors.where("false")).collect() == []
    turns = spark.createDataFrame(
        [(1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "y"), (1, 0, "user", "a")],
        "conv_id long, turn long, role string, text string",
    )
    got = {r.conv_id: r for r in read_back(format_chats(turns)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1}
    assert not got[1].valid and got[None].valid
    assert read_back(format_chats(turns.where("false"))).collect() == []


def test_training_without_labels(spark):
    none = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, label int")
    model = train(none)
    assert model.rows == 0
    assert classify(none, model).first().score == 0.5

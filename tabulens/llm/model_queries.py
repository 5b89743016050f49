"""Queries of the operators that learn from the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import TRAIN_ROWS, classify, train
from .lm_score import score_texts
from .registry import query, table


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    # of the labels as many as training takes, before any text is moved; so few are broadcast
    labels = (
        table(spark, sf_dir, "labels")
        .where(~held_out & F.col("quality").isin(0, 1))
        .select("doc_id", F.col("quality").alias("label"))
        .orderBy(F.xxhash64(F.lit("labels"), "doc_id"), "doc_id", "label")
        .limit(TRAIN_ROWS)
    )
    model = train(docs.join(F.broadcast(labels), "doc_id"))
    return classify(docs.withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", "score", "predicted"
    )


@query("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and n-gram scores of every document, learnt from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fold("doc_id", 10) == 0).withColumnRenamed("id", "doc_id")

"""Queries of the operators that find near rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bag_minhash import near_classes
from .line_dedup import dedup_lines
from .near_vectors import near_vectors
from .registry import query, table


@query("op1_near_vectors")
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_bag_minhash")
def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "component_id", "kept"
    )


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, links, removed lines and digest of what is left of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_links", "n_removed", F.sha2("text", 256).alias("text_sha256")
    )

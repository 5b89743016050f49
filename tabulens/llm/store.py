"""Intermediate tables in the shared folder.

A table is written once, compressed, and read from there by whatever follows, so that a lost
executor recomputes nothing before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tabulens.session import ensure_checkpoint_dir, pin


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def pin_dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` and written: grouping by that key moves its rows no more.

    A written plan only remembers how it is dealt if it is not adaptive.
    """
    spark = df.sparkSession
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        return pin(df.repartition(many, key))


class Store:
    """Tables of one job, written to the folder of spark.checkpoint.dir."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

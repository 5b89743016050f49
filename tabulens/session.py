"""Session helpers: pinned intermediate results and small metadata tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tabulens-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    Used where a value is only fixed once it is written down (row numbers taken from
    partition positions), so a lost executor cannot change it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Arrow types of the column types used in small tables.
_ARROW_TYPES = {
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"),
}


def _arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    return _ARROW_TYPES[name]


def small_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A DataFrame of a few metadata rows (one per column, group or partition).

    Built through Arrow it is a local relation: joining or projecting it starts no job.
    """
    fields = [field.split() for field in schema.split(", ")]
    rows = list(rows)
    arrays = [
        pa.array([row[i] for row in rows], type=_arrow_type(kind))
        for i, (_, kind) in enumerate(fields)
    ]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))

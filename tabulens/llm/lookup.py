"""Join of a large table with one row per key, safe for a key that holds a third of the rows.

Defined cases: keys must not be null on the small side; a row of the large side whose key is null
or unknown is kept, with nulls; empty tables on either side are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# a lookup of at most so many bytes is broadcast
BROADCAST_BYTES = 16_000_000
# beyond that, each key is dealt to so many tasks
SALTS = 64


def look_up(big: DataFrame, small: DataFrame, key: str, row_bytes: Column, spread: Column):
    """``big`` left joined with ``small`` on ``key``.

    ``row_bytes`` is the size of a row of ``small`` and ``spread`` any column of ``big`` that
    differs among the rows of a key. The small side is broadcast if its sum of bytes is at most
    BROADCAST_BYTES; otherwise its rows are repeated SALTS times and the rows of a key are dealt
    to as many tasks.
    """
    total = small.agg(F.sum(row_bytes).alias("b")).first().b or 0
    if total <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key, "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    return salted.join(small.withColumn("_salt", salts), [key, "_salt"], "left").drop("_salt")

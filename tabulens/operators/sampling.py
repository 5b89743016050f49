"""Bounded samples of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 600
SEED = 42
OUTLIER_POINTS = 50


def sample_rows(df: DataFrame, key: Sequence[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """A repeatable random sample: the rows whose keyed digest is smallest.

    Every task keeps only its own ``rows`` best, so nothing but the sample is moved. The
    same rows are drawn however the data is split.
    """
    return df.orderBy(digest([F.col(k) for k in key]), *key).limit(rows)


def digest(key: Sequence[Column]) -> Column:
    """The keyed digest of a row, 32 hexadecimal digits; the smallest make the sample."""
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *[k.cast("string") for k in key]))


def smallest_share(df: DataFrame, key: Sequence[Column], share: float) -> DataFrame:
    """The rows whose digest is in the lowest ``share`` of all digests.

    They hold every sample of fewer rows than there are of them.
    """
    if share >= 1:
        return df
    return df.where(digest(key) < F.lit(f"{int(share * 16**8):08x}"))


def scatter_outliers(points: DataFrame, key: Sequence[str], limit: int = OUTLIER_POINTS) -> DataFrame:
    """The first points (in key order) beyond 1.5 IQR on either axis of (x, y).

    ``points`` is a bounded sample; for whole columns pass known fences to ``beyond``.
    """
    quartiles = F.array(F.lit(0.25), F.lit(0.75))
    qx = points.agg(F.percentile("x", quartiles)).scalar()
    qy = points.agg(F.percentile("y", quartiles)).scalar()
    outside = beyond(F.col("x"), qx[0], qx[1]) | beyond(F.col("y"), qy[0], qy[1])
    return points.where(outside).orderBy(*key).limit(limit).select("x", "y")


def beyond(value: Column, q1: Column, q3: Column) -> Column:
    """Outside the fences 1.5 IQR below Q1 and above Q3."""
    reach = 1.5 * (q3 - q1)
    return (value < q1 - reach) | (value > q3 + reach)

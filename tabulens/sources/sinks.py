"""Writing a report."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F

from tabulens.functions.numbers import null_non_finite
from tabulens.session import pin

if TYPE_CHECKING:
    from tabulens.plans.report import Report


def finite_only(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities in real columns, which JSON cannot hold, by NULL."""
    real = {"float", "double"}
    columns = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in real:
            column = null_non_finite(column)
        elif kind == "array" and f.dataType.elementType.typeName() in real:
            column = F.transform(column, null_non_finite)
        columns.append(column.alias(f.name))
    return df.select(*columns)


# Frames of up to so many rows become one file.
ONE_FILE_ROWS = 100_000


def write_frames(frames: Mapping[str, DataFrame], path: str, fmt: str = "json") -> None:
    """Each frame into its own folder below ``path``.

    A frame is computed in parallel and pinned first. A small one is then gathered into one file, in
    its order; one that holds many rows (a line through all points) is written by all tasks, whose
    files follow its order.
    """
    for name, frame in frames.items():
        pinned = pin(finite_only(frame))
        small = pinned.limit(ONE_FILE_ROWS + 1).count() <= ONE_FILE_ROWS
        writer = (pinned.coalesce(1) if small else pinned).write.mode("overwrite").format(fmt)
        if fmt == "json":
            writer = writer.option("ignoreNullFields", False)
        writer.save(f"{path}/{name}")


def _folder(key: str) -> str:
    """The chart key without characters a path cannot hold."""
    return re.sub(r"[^\w.-]", lambda match: f"%{ord(match[0]):X}", key)


def write_report(report: Report, path: str, fmt: str = "json", chart_data: bool = True) -> None:
    """All small parts of a report and, unless switched off, the data of every chart."""
    write_frames(report.frames(), path, fmt)
    if chart_data:
        charts = {f"chart_data/{_folder(k)}": c.frame for k, c in report.charts.items()}
        write_frames(charts, path, fmt)


def report_document(report: Report) -> DataFrame:
    """One row with the small parts of the report as a single JSON text."""
    parts = []
    for name, frame in report.frames().items():
        row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        rows = pin(finite_only(frame)).coalesce(1).select(row.alias("row"))
        listed = rows.agg(F.array_join(F.collect_list("row"), ",")).scalar()
        parts.append(F.concat(F.lit(f'"{name}":['), listed, F.lit("]")))
    body = F.concat_ws(",", *parts)
    one = report.table.sparkSession.range(1)
    return one.select(F.concat(F.lit("{"), body, F.lit("}")).alias("document"))

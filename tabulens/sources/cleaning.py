"""Cleaning applied to every table that is read."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabulens.batching import batches
from tabulens.functions.numbers import as_number
from tabulens.functions.text import tidy_name
from tabulens.operators.ordinal import is_row_number, key_names, order_keys, with_ordinal

# Fixed values.
MOST_COLUMNS = 300
UNNAMED = re.compile(r"unnamed[:_ ]+\d+", re.IGNORECASE)
BOOLEAN_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get ``.1``, ``.2`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        repeat = seen.get(name, 0)
        seen[name] = repeat + 1
        out.append(f"{name}.{repeat}" if repeat else name)
    return out


def clean_table(
    df: DataFrame,
    order_by: Sequence[str] = (),
    booleans: bool = False,
    max_columns: int | None = MOST_COLUMNS,
) -> DataFrame:
    """Tidy names; drop empty columns, empty rows and row-number columns.

    Columns behind the first ``max_columns`` are dropped with a warning that names them; None keeps
    all.

    One aggregate decides about all columns; the rest are projections and a filter. With
    ``booleans``, text columns that hold nothing but true and false become booleans.
    """
    df = df.toDF(*unique_names([tidy_name(name) for name in df.columns]))
    if not df.columns:
        return df
    order_by = [tidy_name(name) for name in order_by]
    facts = _facts(df)
    kept = [i for i, _ in enumerate(df.columns) if facts[i][0]]
    names = [df.columns[i] for i in kept]
    kept_names = [n for n in names if not UNNAMED.fullmatch(n)]
    # rows are judged on all filled columns, index-like ones included
    quoted = [f"`{n}`" for n in names]
    df = df.select(*quoted).dropna(how="all", subset=quoted) if names else df.select()
    for name in list(kept_names):
        if name.lower() == "index" and _counts_rows(df, name, order_by):
            kept_names.remove(name)
    if max_columns is not None and len(kept_names) > max_columns:
        dropped = ", ".join(kept_names[max_columns:])
        warnings.warn(f"columns beyond the first {max_columns} are dropped: {dropped}", stacklevel=2)
        kept_names = kept_names[:max_columns]
    columns = []
    for name in kept_names:
        present, words = facts[kept[names.index(name)]]
        column = F.col(f"`{name}`")
        is_boolean = booleans and words == present
        columns.append(F.lower(column).cast("boolean").alias(name) if is_boolean else column)
    return df.select(*columns)


def _facts(df: DataFrame) -> dict[int, tuple[int, int]]:
    """Values and boolean words per column position.

    Cells are lined up as (pos, ...) rows and summed at once inside each task, which keeps
    the plan small for any number of columns.
    """
    found = {i: (0, 0) for i, _ in enumerate(df.columns)}
    for batch in batches(list(enumerate(df.schema.fields))):
        cells = []
        for i, f in batch:
            column = F.col(f"`{f.name}`")
            text = f.dataType.typeName() == "string"
            word = F.coalesce(column.isin(*BOOLEAN_WORDS), F.lit(False)) if text else F.lit(False)
            cells += [F.lit(i), column.isNotNull(), word]
        long = df.select(F.stack(F.lit(len(batch)), *cells).alias("pos", "present", "word"))
        counts = long.groupBy("pos").agg(
            F.count_if("present").alias("n"), F.count_if("word").alias("b")
        )
        found.update({row["pos"]: (row["n"], row["b"]) for row in counts.collect()})
    return found


def _counts_rows(df: DataFrame, name: str, order_by: Sequence[str]) -> bool:
    """Whether the column is 0, 1, 2, ... in row order.

    Rows are only numbered if count, range and sum already fit.
    """
    number = as_number(F.col(f"`{name}`"), df.schema[name].dataType)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(number).alias("n"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.sum(number).alias("total"),
    ).first()
    rows = row["rows"]
    if not rows or row["n"] < rows or row["low"] != 0 or row["high"] != rows - 1:
        return False
    if row["total"] != rows * (rows - 1) / 2:
        return False
    values = df.select(*order_keys(order_by), number.alias("value"))
    numbered = with_ordinal(values, key_names(order_by))
    return bool(is_row_number(numbered, F.col("value")).first()["is_row_number"])

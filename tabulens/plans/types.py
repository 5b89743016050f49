"""Semantic column types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulens.batching import batches
from tabulens.functions.dates import DATE_FORMATS, DATE_TYPES, as_timestamp, parse_date, pick_format
from tabulens.functions.numbers import NUMERIC_TYPES, as_number, is_number_text
from tabulens.functions.text import named
from tabulens.operators.accumulate import SHORT, Facts, column_facts
from tabulens.operators.frequency import distinct_counts, text_key, to_long
from tabulens.session import small_table

# Fixed values of the type rules.
NUMERIC_SHARE = 0.90
DATE_SAMPLE = 30
CATEGORY_RATIO = 0.50
CATEGORY_VALUES = 100

# How any accepted date begins; columns without such a value need no closer look.
DATE_START = r"^(\d{1,4}[-/]\d|\d{1,2} [A-Za-z]{3} \d|[A-Za-z]{3} \d)"


@dataclass(frozen=True)
class ColumnType:
    """A column, what it is taken for, and what the type pass learned about it."""

    name: str
    pos: int
    dtype: T.DataType
    kind: str = "text"
    date_format: str | None = None
    total: int = 0
    present: int = 0
    longest: int = 0
    n_unique: int | None = None
    facts: Facts | None = field(default=None, compare=False, repr=False)

    @property
    def column(self) -> Column:
        return named(self.name)

    @property
    def number(self) -> Column:
        return as_number(self.column, self.dtype)

    @property
    def timestamp(self) -> Column:
        return as_timestamp(self.column, self.dtype, self.date_format)

    @property
    def text(self) -> Column:
        if isinstance(self.dtype, T.BooleanType):
            return F.when(self.column, "True").when(~self.column, "False")
        return self.column.cast("string")

    @property
    def is_measured(self) -> bool:
        """Numeric with metrics; booleans count as numeric but have none."""
        return self.kind == "numeric" and not isinstance(self.dtype, T.BooleanType)


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, NUMERIC_TYPES):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, DATE_TYPES):
        return "date"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "nested"


def detect_types(df: DataFrame, order_by: Sequence[str] = ()) -> list[ColumnType]:
    """The semantic type of every column.

    One scan counts values, numbers and date-like texts per column, and lists the values of
    columns with few; only text columns with many, and those that may be dates, are looked at
    again. What the scan found stays with the types, for the profile. ``order_by`` says which rows come first; without it the
    order of reading does.
    """
    columns = [ColumnType(f.name, i, f.dataType) for i, f in enumerate(df.schema.fields)]
    if not columns:
        return []
    facts = {}
    for batch in batches(columns):
        facts.update(_scan(df, batch))
    columns = [_with_facts(c, facts.get(c.pos, Facts())) for c in columns]
    undecided = [c for c in columns if c.kind == "undecided"]
    dates = _date_formats(df, [c for c in undecided if c.facts.dated], order_by)
    columns = [
        replace(c, kind="date", date_format=dates[c.pos]) if c.pos in dates else c for c in columns
    ]
    undecided = [c for c in columns if c.kind == "undecided"]
    return _categories(df, columns, undecided)


def _scan(df: DataFrame, columns: Sequence[ColumnType]) -> dict[int, Facts]:
    """What one scan tells about each column position."""
    cells = {}
    for c in columns:
        family = _family(c.dtype)
        if family in ("float", "number"):
            cells[c.pos] = {"number": c.number}
        elif family == "string":
            short = F.length(c.column) <= SHORT
            cells[c.pos] = {
                "number": c.number,
                "word": F.when(short, c.column).cast("binary"),
                "written": F.coalesce(is_number_text(c.column), F.lit(False)),
                "dated": F.coalesce(c.column.rlike(DATE_START), F.lit(False)),
                "length": F.length(c.column),
            }
        elif family == "bool":
            cells[c.pos] = {"word": c.text.cast("binary")}
        else:
            cells[c.pos] = {"present": c.column.isNotNull()}
    return column_facts(df, cells)


def _with_facts(column: ColumnType, facts: Facts) -> ColumnType:
    total, present = facts.total, facts.present
    family = _family(column.dtype)
    kind = {"float": "numeric", "number": "numeric", "date": "date", "nested": "nested"}.get(family)
    if family == "bool":
        # with gaps a boolean column is a column of texts
        kind = "numeric" if present == total else "undecided"
    if family == "string":
        is_number = present and facts.written / present >= NUMERIC_SHARE
        kind = "numeric" if is_number else "undecided"
    if present == 0 and family != "nested":
        kind = "text"
    return replace(
        column, kind=kind, total=total, present=present, longest=facts.longest, facts=facts
    )


def _date_formats(
    df: DataFrame, columns: Sequence[ColumnType], order_by: Sequence[str]
) -> dict[int, str]:
    """Date format by position, for columns whose first 30 values all follow one.

    Each column contributes 30 values; a task keeps at most 30 of its own.
    """
    parts = []
    for c in columns:
        rows = df.where(c.column.isNotNull())
        rows = rows.orderBy(*[named(key) for key in order_by]) if order_by else rows
        readable = F.struct(*[parse_date(c.column, f).isNotNull().alias(f) for f in DATE_FORMATS])
        first = rows.limit(DATE_SAMPLE)
        parts.append(first.select(F.lit(c.pos).alias("pos"), readable.alias("ok")))
    if not parts:
        return {}
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    samples: dict[int, list[dict[str, bool]]] = {}
    for row in union.collect():
        samples.setdefault(row["pos"], []).append(row["ok"].asDict())
    formats = {pos: pick_format(sample) for pos, sample in samples.items()}
    return {pos: fmt for pos, fmt in formats.items() if fmt is not None}


def _categories(
    df: DataFrame, columns: Sequence[ColumnType], undecided: Sequence[ColumnType]
) -> list[ColumnType]:
    if not undecided:
        return list(columns)
    listed = {c.pos: c.facts.texts() for c in undecided}
    distinct = {pos: len(texts) for pos, texts in listed.items() if texts is not None}
    for batch in batches([c for c in undecided if c.pos not in distinct]):
        long = to_long(df, {c.pos: text_key(c.text, c.longest) for c in batch})
        distinct.update({row["pos"]: row["n_unique"] for row in distinct_counts(long).collect()})
    out = []
    for c in columns:
        if c.kind == "undecided":
            n = distinct.get(c.pos, 0)
            few = n <= CATEGORY_VALUES and n / c.present < CATEGORY_RATIO
            c = replace(c, kind="categorical" if few else "text", n_unique=n)
        out.append(c)
    return out


def types_frame(df: DataFrame, columns: Sequence[ColumnType]) -> DataFrame:
    rows = [(c.name, c.pos, c.kind) for c in columns]
    return small_table(df.sparkSession, rows, "column string, position int, type string")

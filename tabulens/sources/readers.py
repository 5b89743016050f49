"""Readers for delimited text and JSON. Any other source is a DataFrame already."""

from __future__ import annotations

import codecs
import csv
import io
import re
import uuid
import warnings
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabulens.functions.text import null_na_tokens
from tabulens.session import ensure_checkpoint_dir
from tabulens.sources import json_records
from tabulens.sources.cleaning import MOST_COLUMNS, clean_table, unique_names

# Fixed values.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_LINES = 10
EXTRA = "_extra_field"


def read_table(
    spark: SparkSession,
    path: str,
    ext: str | None = None,
    encoding: str = "utf-8",
    max_columns: int | None = MOST_COLUMNS,
) -> DataFrame:
    """Read and clean a file or folder; the kind is taken from ``ext`` or the file name."""
    kind = (ext or path.rsplit(".", 1)[-1]).lower().lstrip(".")
    if kind == "csv":
        return read_csv(spark, path, encoding=encoding, max_columns=max_columns)
    if kind == "json":
        return read_json(spark, path, encoding, max_columns=max_columns)
    if kind in ("xls", "xlsx"):
        raise ValueError("Workbooks are not read; save the sheet as CSV.")
    raise ValueError(f"Unsupported file extension: .{kind}")


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """The delimiter found equally often in each of the first lines; a comma if none is."""
    return _even_delimiter(_head(spark, path, _charset(encoding)))


def _head(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """The first lines."""
    raw = F.col("value").cast("binary").alias("value")
    lines = [bytes(r.value) for r in spark.read.text(path).select(raw).limit(SNIFF_LINES).collect()]
    return [line.decode(encoding, "replace").lstrip("\ufeff") for line in lines]


def _even_delimiter(lines: Sequence[str]) -> str:
    counts = {d: {line.count(d) for line in lines if line.strip()} for d in DELIMITERS}
    even = [(n.copy().pop(), -i, d) for i, (d, n) in enumerate(counts.items()) if len(n) == 1]
    most = max(even, default=(0, 0, ","))
    return most[2] if most[0] > 0 else ","


def _broken_lines(spark: SparkSession, path: str, sep: str) -> tuple[int, int]:
    """Lines that end inside a quoted field, and lines with bytes that are not UTF-8.

    Only a quote at the start of a field opens it, so one inside a plain field does not count.
    """
    line, cut = F.col("value"), re.escape(sep)
    closed = F.regexp_replace(line, f'(^|{cut})"(?:[^"]|"")*+"(?={cut}|\\s*$)', "$1")
    opened = line.contains('"') & closed.rlike(f'(^|{cut})"')
    row = spark.read.text(path).agg(F.count_if(opened), F.count_if(~F.is_valid_utf8(line))).first()
    return row[0], row[1]


def _charset(encoding: str) -> str:
    """The name Spark knows an encoding by."""
    name = codecs.lookup(encoding).name
    wide = name.replace("utf-16-", "utf-16").replace("utf-32-", "utf-32")
    return {"iso8859-1": "ISO-8859-1", "utf-8-sig": "utf-8"}.get(name, wide)


def _undecodable(lines: int) -> ValueError:
    return ValueError(
        f"{lines} lines hold characters that are not UTF-8; pass encoding, such as 'latin-1'."
    )


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str = "utf-8",
    multi_line: bool | None = None,
    clean: bool = True,
    max_columns: int | None = MOST_COLUMNS,
) -> DataFrame:
    """Delimited text with a header line; every column as text, missing-value tokens NULL.

    Rows with too many fields are left out, short ones padded. Files are read in splits unless
    ``multi_line`` is set; without a choice of the caller, a pass over the lines looks for quoted
    fields that go on in the next line and sets it where it finds any, with a warning. The same pass
    looks for text that is not UTF-8, which raises an error where no other ``encoding`` is given.
    """
    encoding = _charset(encoding)
    utf8 = encoding == "utf-8"
    head = _head(spark, path, encoding)
    sep = sep or _even_delimiter(head)
    if multi_line is None or utf8:
        opened, undecodable = _broken_lines(spark, path, sep)
        if utf8 and undecodable:
            raise _undecodable(undecodable)
        if multi_line is None:
            multi_line = opened > 0
            if multi_line:
                warnings.warn(
                    f"{opened} lines end inside quotes: each file is read as a whole", stacklevel=2
                )
    reader = (
        spark.read.option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    filled = [line for line in head if line.strip()]
    first = next(csv.reader(io.StringIO("\n".join(filled)), delimiter=sep), None)
    if not first:
        raise ValueError("CSV parsing failed")
    names = [name or f"Unnamed: {i}" for i, name in enumerate(first)]
    names = unique_names(names)
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    schema = T.StructType([*fields, T.StructField(EXTRA, T.StringType())])
    rows = reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    # the one field too many tells a long row from a complete one
    kept = rows.where(F.col(EXTRA).isNull())
    df = kept.select(*[null_na_tokens(F.col(f.name)).alias(n) for f, n in zip(fields, names)])
    return clean_table(df, booleans=True, max_columns=max_columns) if clean else df


def _structure(text: Column) -> Column:
    """Number of brackets, commas and colons outside of strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    return F.length(F.regexp_replace(bare, r"[^{}\[\],:]+", ""))


def _line_facts(lines: DataFrame) -> tuple[int, int, int]:
    """Filled lines, those that are one whole object, and those that are not UTF-8.

    Spark's parser stops behind the first value of a line; a line is one value if that value has all
    of the line's structure.
    """
    line = F.trim(F.translate("value", "\t\r", "  "))
    first = F.get_json_object(line, "$")
    whole = (
        line.startswith("{")
        & line.endswith("}")
        & first.isNotNull()
        & (_structure(first) == _structure(line))
    )
    filled = line != ""
    row = lines.agg(
        F.count_if(filled), F.count_if(filled & whole), F.count_if(~F.is_valid_utf8("value"))
    ).first()
    return row[0], row[1], row[2]


def _as_utf8(spark: SparkSession, path: str, encoding: str) -> str:
    """The lines written anew in UTF-8, for what Spark does not decode or split in lines.

    A mark at the start tells the byte order; without one, little-endian is taken.
    """
    name = encoding.upper()
    if name in ("UTF-16", "UTF-32"):
        row = spark.read.text(path).select(F.hex(F.col("value").cast("binary"))).first()
        big = row is not None and row[0].startswith("FEFF" if name == "UTF-16" else "0000FEFF")
        name += "BE" if big else "LE"
    reader = spark.read
    if name.startswith(("UTF-16", "UTF-32")):
        reader = reader.option("encoding", name).option("lineSep", "\n")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [v.decode(name).strip("\ufeff\r") for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    folder = f"{ensure_checkpoint_dir(spark)}/utf8-{uuid.uuid4().hex}"
    raw = reader.text(path).select(F.col("value").cast("binary").alias("value"))
    raw.mapInArrow(decode, "value string").write.text(folder)
    return folder


def _keep_records(spark: SparkSession, records: DataFrame) -> str:
    """The records written as one line each; a scalar becomes a record with the column 0."""
    value = F.col("value")
    record = F.when(value.startswith("{"), value)
    scalar = F.when(~value.startswith("["), F.concat(F.lit('{"0":'), value, F.lit("}")))
    folder = f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    records.select(F.coalesce(record, scalar, F.lit("["))).write.text(folder)
    return folder


def read_json(
    spark: SparkSession,
    path: str,
    encoding: str = "utf-8",
    clean: bool = True,
    max_columns: int | None = MOST_COLUMNS,
) -> DataFrame:
    """JSON in one of these forms: a record per line; records one after another, on a line or over
    many; one or more arrays of records; an object that wraps such an array; an object of columns;
    a single flat object. Files of a folder have the same form.

    No record is lost without an error. One pass counts the lines that are whole records; where all
    are, Spark reads the files as they are. Other forms are taken apart in splits (see
    json_records.py) and written as a record per line; an object of columns is read whole. Text that
    is not UTF-8 raises an error where no other ``encoding`` is given; a byte order mark is skipped.
    """
    if _charset(encoding) != "utf-8":
        path = _as_utf8(spark, path, _charset(encoding))
    lines = json_records.text_lines(spark, path)
    filled, whole, undecodable = _line_facts(lines)
    if undecodable:
        raise _undecodable(undecodable)
    if not filled:
        raise ValueError("The file is empty.")
    found = None
    # one object alone may be a wrapper or columns
    if whole < filled or filled == 1 or whole == lines.select("file").distinct().count():
        found = json_records.outline(lines, json_records.open_brackets(lines))
        records = json_records.records(lines, found)
    if found is not None and records is None:
        document = spark.read.text(path, wholetext=True)
        df = spark.read.option("multiLine", True).json(path)
        if "_corrupt_record" in df.columns:
            raise ValueError("The file is not valid JSON.")
        df, keys = _columns(df, document)
    else:
        if found is not None:
            path = _keep_records(spark, records)
        df = spark.read.json(path)
        if "_corrupt_record" in df.columns:
            raise ValueError("The file is not valid JSON.")
        keys = _key_order(spark.read.text(path).where(F.trim("value") != "").limit(1), "$")
    order = [k for k in keys if k in df.columns] + [c for c in df.columns if c not in keys]
    df = df.select(*[f"`{name}`" for name in order])
    return clean_table(df, max_columns=max_columns) if clean else df


def _key_order(text: DataFrame, path: str) -> list[str]:
    """Keys of the first record, in the order written."""
    row = text.select(
        F.json_object_keys(F.get_json_object(F.col("value"), path)).alias("keys")
    ).first()
    return list(row["keys"] or []) if row else []


def _columns(df: DataFrame, document: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of files that are one object each: a record, or columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = _key_order(document, "$")
    arrays = [name for name, kind in kinds.items() if isinstance(kind, T.ArrayType)]
    objects = [name for name, kind in kinds.items() if isinstance(kind, T.StructType)]
    if not arrays and not objects:
        return df, keys
    if arrays and objects:
        raise ValueError("JSON must hold records, or columns of one kind.")
    names = list(kinds)
    if objects:
        return _from_labelled(df, names, kinds), keys
    sizes = F.array_distinct(F.array(*[F.size(f"`{name}`") for name in arrays]))
    if df.agg(F.max(F.size(sizes))).first()[0] > 1:
        raise ValueError("All columns must have the same number of values.")
    zipped = F.arrays_zip(*[F.col(f"`{name}`").alias(name) for name in arrays])
    others = [F.col(f"`{name}`") for name in names if name not in arrays]
    return df.select(*others, F.inline(zipped)), keys


def _from_labelled(
    df: DataFrame, names: Sequence[str], kinds: dict[str, T.DataType]
) -> DataFrame:
    """``{"a": {"0": 1, "1": 2}}``: the inner keys are row labels."""
    labels: list[str] = []
    for name in names:
        if isinstance(kinds[name], T.StructType):
            labels += [label for label in kinds[name].fieldNames() if label not in labels]

    def cell(name: str, label: str) -> Column:
        column, kind = F.col(f"`{name}`"), kinds[name]
        if not isinstance(kind, T.StructType):
            return column.alias(name)
        value = column.getField(label) if label in kind.fieldNames() else F.lit(None)
        return value.alias(name)

    rows = [F.struct(*[cell(name, label) for name in names]) for label in labels]
    return df.select(F.inline(F.array(*rows)))

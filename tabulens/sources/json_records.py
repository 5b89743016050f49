"""The records of JSON text that is not one record a line.

A file may hold an array of records, several arrays, records one after another (on one line or
over many), or an object that wraps an array. Files are read in splits. A JSON string cannot hold a
line break, so every line begins outside of strings, and what a split cannot know of itself is
only which brackets were open before it:

1. ``open_brackets`` scans each split for the brackets it leaves open or closes beyond its start;
   the driver puts these together, split by split, and knows the brackets open at every start.
2. ``outline`` scans again from there and counts what stands at the top: values of each kind, and
   the wrapping keys with arrays. The driver decides where the records are, or that there are none.
3. ``records`` scans a last time and writes each record as a line. A record that goes on in the next
   split comes in parts, which are put together by a window over these parts alone.

So each record of the text is a line of the result: what Spark then parses can be no fewer. Text that
is no JSON is found by its brackets here, or by Spark's parser afterwards. The driver sees a short
row for each split.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Keys that may wrap the records, the first of them that holds an array counts.
WRAPPERS = ("data", "results", "records", "rows", "items")
OPEN = {"}": "{", "]": "["}

_mark = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[{}\[\],:]')
_bracket = re.compile(r'"(?:[^"\\]|\\.)*+"?|[{}\[\]]')


class NotJson(ValueError):
    """The text is not JSON, or not of a form that holds records."""

    def __init__(self, why: str):
        super().__init__(f"The file is not valid JSON of a known form: {why}.")


def text_lines(spark, path: str) -> DataFrame:
    """(value, file, block) of all lines; a block is a split of a file."""
    return spark.read.text(path).select(
        F.ltrim(F.col("value"), F.lit("\ufeff")).alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """The lines of each block, one after the other."""

    def rows() -> Iterator[tuple[str, int, str]]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
            yield from zip(*columns, strict=True)

    every = rows()
    ahead = next(every, None)

    def lines(key: tuple[str, int]) -> Iterator[str]:
        nonlocal ahead
        while ahead is not None and ahead[:2] == key:
            yield ahead[2]
            ahead = next(every, None)

    while ahead is not None:
        key = ahead[:2]
        own = lines(key)
        yield *key, own
        for _ in own:  # what was not read
            pass


def _open_brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for file, block, lines in _blocks(batches):
        opened: list[str] = []
        closed: list[str] = []
        sound = True
        for line in lines:
            for m in _bracket.finditer(line):
                c = m[0]
                if c in OPEN:
                    if not opened:
                        closed.append(c)
                    elif opened.pop() != OPEN[c]:
                        sound = False
                elif c in "{[":
                    opened.append(c)
        out.append((file, block, "".join(closed), "".join(opened), sound))
    yield _batch(out, ("file", "block", "closed", "opened", "sound"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {
        "block": pa.int64(), "at": pa.int64(), "values": pa.int64(), "sound": pa.bool_(),
        "head": pa.bool_(), "tail": pa.bool_(), "arrays": pa.list_(pa.string()),
    }
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    arrays = [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


@dataclass
class Start:
    """What is open where a split begins."""

    stack: str = ""
    key: str | None = None


@dataclass
class Outline:
    """What a folder of files holds: where each split starts, and the values at the top."""

    starts: dict[tuple[str, int], Start]
    kinds: set[str] = field(default_factory=set)
    most: int = 0  # values of a file at most
    wrapped: dict[str, str] = field(default_factory=dict)  # file -> wrapping key


def open_brackets(lines: DataFrame) -> dict[tuple[str, int], Start]:
    """The brackets that are open at the start of every split."""
    rows = lines.mapInArrow(
        _open_brackets, "file string, block long, closed string, opened string, sound boolean"
    ).collect()
    files = defaultdict(list)
    for row in rows:
        files[row.file].append(row)
    starts = {}
    for own in files.values():
        stack: list[str] = []
        for row in sorted(own, key=lambda r: r.block):
            starts[row.file, row.block] = Start("".join(stack))
            if not row.sound:
                raise NotJson("brackets do not match")
            for c in row.closed:
                if not stack or stack.pop() != OPEN[c]:
                    raise NotJson("brackets do not match")
            stack.extend(row.opened)
        if stack:
            raise NotJson("it ends inside a value")
    return starts


def _outline(
    batches: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], Start]
) -> Iterator[pa.RecordBatch]:
    out = []
    for file, block, lines in _blocks(batches):
        stack = list(starts[file, block].stack)
        kinds: set[str] = set()
        values, key, sound = 0, None, True
        arrays: list[str] = []
        string = None  # the last string at depth one, a key if a colon follows
        for line in lines:
            at = 0
            for m in _mark.finditer(line):
                c = line[m.start()]
                between = line[at : m.start()].strip()
                at = m.end()
                if between and not stack:
                    kinds.add("scalar")
                if c == '"':
                    sound = sound and m[1] == '"'
                    if not stack:
                        kinds.add("scalar")
                    string = m[0][1:-1]
                elif c in "{[":
                    if not stack:
                        values += 1
                        kinds.add(c)
                    elif stack == ["{"] and c == "[":
                        # the key of a block's first value is that of the block before
                        arrays.append(key if key is not None else "")
                    stack.append(c)
                elif c in OPEN:
                    stack.pop()
                elif not stack:
                    kinds.add("comma" if c == "," else "colon")
                elif c == ":" and stack == ["{"]:
                    key = string
            if line[at:].strip() and not stack:
                kinds.add("scalar")
        names = [a for a in dict.fromkeys(arrays) if a == "" or a in WRAPPERS]
        out.append((file, block, values, "".join(sorted({k[0] for k in kinds})), names, key, sound))
    yield _batch(out, ("file", "block", "values", "kinds", "arrays", "key", "sound"))


def outline(lines: DataFrame, starts: dict[tuple[str, int], Start]) -> Outline:
    """What stands at the top of the files."""
    rows = lines.mapInArrow(
        lambda b: _outline(b, starts),
        "file string, block long, values long, kinds string, arrays array<string>, key string,"
        " sound boolean",
    ).collect()
    out = Outline(starts)
    files = defaultdict(list)
    for row in rows:
        files[row.file].append(row)
        out.kinds |= set(row.kinds)
    for file, own in files.items():
        key, arrays = None, set()
        for row in sorted(own, key=lambda r: r.block):
            if not row.sound:
                raise NotJson("a string does not end on its line")
            out.starts[file, row.block].key = key
            arrays |= {a or key for a in row.arrays}
            key = row.key if row.key is not None else key
        out.most = max(out.most, sum(r.values for r in own))
        found = [w for w in WRAPPERS if w in arrays]
        if found:
            out.wrapped[file] = found[0]
    return out


def _records(
    batches: Iterator[pa.RecordBatch],
    starts: dict[tuple[str, int], Start],
    depth: int,
    keys: dict[str, str],
) -> Iterator[pa.RecordBatch]:
    """(file, block, at, value, head, tail) of the parts of records of each split."""
    names = ("file", "block", "at", "value", "head", "tail")
    for file, block, lines in _blocks(batches):
        start = starts[file, block]
        stack, key, wanted = list(start.stack), start.key, keys.get(file)
        string = None
        out: list[tuple] = []
        number = 0

        def inside() -> bool:
            """Whether this is the container of records, or deeper in it."""
            return len(stack) >= depth and (depth < 2 or key == wanted)

        parts: list[str] | None = [] if inside() and len(stack) > depth else None
        head = parts is None

        def emit(tail: bool) -> None:
            nonlocal parts, head, number
            text = " ".join(p for p in parts if p)
            if text or not (head and tail):
                out.append((file, block, number, text, head, tail))
                number += 1
            parts, head = None, True

        for line in lines:
            begin = 0  # of what belongs to the record of this line
            at = 0
            for m in _mark.finditer(line):
                c = line[m.start()]
                if parts is None and inside() and len(stack) == depth:
                    if depth and line[at : m.start()].strip():
                        parts, begin = [], at  # a scalar before this mark
                    elif c in '{["':
                        parts, begin = [], m.start()
                at = m.end()
                if c == '"':
                    string = m[0][1:-1]
                elif c in "{[":
                    stack.append(c)
                elif c in OPEN:
                    if parts is not None and len(stack) == depth:
                        parts.append(line[begin : m.start()].strip())
                        emit(True)
                    stack.pop()
                    if parts is not None and depth == 0 and not stack:
                        parts.append(line[begin:at].strip())
                        emit(True)
                elif c == "," and parts is not None and len(stack) == depth:
                    parts.append(line[begin : m.start()].strip())
                    emit(True)
                elif c == ":" and stack == ["{"]:
                    key = string
            rest = line[at:].strip()
            if parts is not None:
                parts.append(line[max(begin, 0) :].strip())
            elif rest and depth and inside() and len(stack) == depth:
                parts = [rest]
            if len(out) >= 1000:
                yield _batch(out, names)
                out.clear()
        if parts is not None:
            emit(False)
        yield _batch(out, names)


def records(lines: DataFrame, found: Outline) -> DataFrame | None:
    """One row ``value`` for each record; None if each file is one object that wraps nothing."""
    if found.kinds == {"["}:
        depth = 1
    elif found.kinds != {"{"}:
        raise NotJson("records are objects, alone or in arrays" if found.kinds else "no value")
    elif found.most > 1:
        depth = 0
    elif found.wrapped:
        if len(found.wrapped) < len({file for file, _ in found.starts}):
            raise NotJson("only some of the files wrap an array")
        depth = 2
    else:
        return None
    starts, keys = found.starts, found.wrapped
    scan: Callable = lambda b: _records(b, starts, depth, keys)
    parts = lines.mapInArrow(
        scan, "file string, block long, at long, value string, head boolean, tail boolean"
    )
    if len(starts) == len({file for file, _ in starts}):
        return parts.select("value")
    # at most two parts of a record are in a block: the window sees no other rows
    cut = parts.where("NOT (head AND tail)")
    by_file = Window.partitionBy("file").orderBy("block", "at")
    joined = (
        cut.withColumn("number", F.sum(F.col("head").cast("int")).over(by_file))
        .groupBy("file", "number")
        .agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
        .select(F.array_join("parts.value", " ").alias("value"))
    )
    return parts.where("head AND tail").select("value").unionByName(joined)

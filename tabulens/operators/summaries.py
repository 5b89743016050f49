"""Summaries of columns that add up: moments, counts, ranks, and the distinct values.

Each task sorts a piece of a column once. From the sorted piece come the moments (``Facts``), the
ranks, and the distinct values, which are all that goes on to the aggregates of Spark: a value that
fills the piece is one row there. Values are listed with exact counts while a column has few.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabulens.operators.accumulate import Facts

# values of a column are listed while they are fewer than this, longer ones are not
LISTED, SHORT = 1000, 256
# what the mark of a text tells, below its length * 4
BLANK, NUMERAL = 1, 2
# items that a level of ranks holds; rows and bytes of a piece
LEVEL = 1024
PIECE, PIECE_BYTES = 1 << 16, 1 << 25
# summaries that one step of a merge takes together
TOGETHER = 64

# what a cell can tell: see ``summaries``
ROLES = ("number", "whole", "stamp", "word", "mark", "present")

_FACTS = {
    "total": "total", "present": "present", "numbers": "written", "dates": "dated", "n": "n",
    "sum": "sum", "mean": "mean", "m2": "m2", "m3": "m3", "m4": "m4", "min": "low", "max": "high",
    "zeros": "zeros", "negatives": "negatives", "integers": "integers",
}
_OWN = ("first", "last", "characters", "shortest", "longest", "blanks", "listed")
STATE = (
    "total: long, present: long, numbers: long, dates: long, n: long, sum: double, mean: double,"
    " m2: double, m3: double, m4: double, min: double, max: double, zeros: long, negatives: long,"
    " integers: long, first: timestamp_ntz, last: timestamp_ntz, characters: long, shortest: int,"
    " longest: int, blanks: long, listed: boolean, ranks: array<array<double>>,"
    " lengths: array<array<double>>"
)
ITEMS = "array<struct<item: string, count: long>>"
_TYPES = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"), "array<array<double>>": pa.list_(pa.list_(pa.float64())),
}
_STATE = pa.struct([(f.split(": ")[0].strip(), _TYPES[f.split(": ")[1]]) for f in STATE.split(",")])
_ITEMS = pa.list_(pa.struct([("item", pa.string()), ("count", pa.int64())]))
_SCAN = "part int, position int, number double, whole long, stamp timestamp_ntz, word string, n long"
_SCANNED = pa.schema(
    [
        ("part", pa.int32()), ("position", pa.int32()), ("number", pa.float64()),
        ("whole", pa.int64()), ("stamp", pa.timestamp("us")), ("word", pa.string()),
        ("n", pa.int64()), ("state", _STATE),
    ]
)


class Ranks:
    """Values by level; one of level i stands for 2**i rows.

    A level that is full is sorted and every second value goes up, from the first or the second on.
    Which of them is drawn (by a fixed seed), so the errors of merged summaries do not pile up. Of n
    rows a rank is off by about n / LEVEL / 2; up to LEVEL rows it is exact.
    """

    def __init__(self, seed: Sequence[int], levels: Iterable[np.ndarray] = ()) -> None:
        self.draw = np.random.default_rng(seed)
        self.levels = list(levels)

    def add(self, ordered: np.ndarray) -> None:
        """Take in sorted values; of many, one of each run of 2**i goes to its level at once."""
        level = max(0, (len(ordered) // (LEVEL // 2)).bit_length() - 1)
        stride = 1 << level
        whole = len(ordered) // stride * stride
        self._put(level, ordered[self.draw.integers(stride) : whole : stride])
        self._put(0, ordered[whole:])

    def merge(self, other: Ranks) -> None:
        for level, values in enumerate(other.levels):
            self._put(level, values)

    def _put(self, level: int, values: np.ndarray) -> None:
        while len(values):
            while len(self.levels) <= level:
                self.levels.append(np.empty(0))
            values = np.concatenate([self.levels[level], values])
            if len(values) < LEVEL:
                self.levels[level] = values
                return
            values = np.sort(values, kind="stable")
            even = len(values) // 2 * 2
            self.levels[level] = values[even:].copy()
            values = values[self.draw.integers(2) : even : 2]
            level += 1

    def quantiles(self, probabilities: Sequence[float]) -> list[float] | None:
        """The least values that so many of the rows do not exceed."""
        values = np.concatenate([*self.levels, np.empty(0)])
        if not len(values):
            return None
        weights = np.repeat([1 << i for i in range(len(self.levels))], [len(v) for v in self.levels])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        places = np.searchsorted(upto, np.asarray(probabilities) * upto[-1])
        return values[order][np.minimum(places, len(values) - 1)].tolist()


def quantiles(ranks: str, probabilities: Sequence[float]) -> Column:
    """Quantiles from a column of ranks, NULL where there are no values."""

    @F.arrow_udf("array<double>")
    def read(column: pa.Array) -> pa.Array:
        found = [None if r is None else _ranks(r, ()).quantiles(probabilities) for r in column]
        return pa.array(found, pa.list_(pa.float64()))

    return read(F.col(ranks))


def _ranks(levels: pa.ListScalar, seed: Sequence[int]) -> Ranks:
    if not levels.is_valid:
        return Ranks(seed)
    return Ranks(seed, [level.values.to_numpy() for level in levels])


@dataclass
class Summary:
    """What is known about some rows of a column."""

    seed: tuple[int, ...]
    facts: Facts = field(default_factory=lambda: Facts(words=None))
    first: int | None = None
    last: int | None = None
    characters: int = 0
    shortest: int | None = None
    longest: int | None = None
    blanks: int = 0
    listed: bool = True

    def __post_init__(self) -> None:
        self.ranks, self.lengths = Ranks((*self.seed, 0)), Ranks((*self.seed, 1))

    @classmethod
    def of(cls, state: pa.StructScalar, seed: tuple[int, ...]) -> Summary:
        summary = cls(seed)
        for name, own in _FACTS.items():
            if state[name].is_valid:
                setattr(summary.facts, own, state[name].as_py())
        for name in _OWN:
            cell = state[name]
            setattr(summary, name, cell.value if name in ("first", "last") else cell.as_py())
        summary.ranks = _ranks(state["ranks"], (*seed, 0))
        summary.lengths = _ranks(state["lengths"], (*seed, 1))
        return summary

    def state(self) -> dict[str, object]:
        state = {name: getattr(self.facts, own) for name, own in _FACTS.items()}
        if not self.facts.n:
            state["min"] = state["max"] = None
        state.update({name: getattr(self, name) for name in _OWN})
        return state | {"ranks": self.ranks.levels, "lengths": self.lengths.levels}

    def merge(self, other: Summary) -> None:
        self.facts.merge(other.facts)
        self._widen(other.first, other.last, other.shortest, other.longest)
        self.characters += other.characters
        self.blanks += other.blanks
        self.listed = self.listed and other.listed
        self.ranks.merge(other.ranks)
        self.lengths.merge(other.lengths)

    def _widen(self, first=None, last=None, shortest=None, longest=None) -> None:
        self.first = min((x for x in (self.first, first) if x is not None), default=None)
        self.last = max((x for x in (self.last, last) if x is not None), default=None)
        self.shortest = min((x for x in (self.shortest, shortest) if x is not None), default=None)
        self.longest = max((x for x in (self.longest, longest) if x is not None), default=None)

    def add(
        self, rows: int, cells: Mapping[str, pa.Array], value: str | None
    ) -> tuple[pa.Array, pa.Array] | None:
        """Take in a piece; the distinct values of the cell ``value``, their counts beside them."""
        present = cells["present"].true_count if value is None else rows - cells[value].null_count
        piece = Facts(total=rows, present=present, words=None)
        ordered = {}
        for role in ("number", "whole", "stamp"):
            if role in cells:
                cell = cells[role].drop_null()
                cell = cell.cast(pa.int64()) if role == "stamp" else cell
                plain = cell.to_numpy(zero_copy_only=False)
                # -0.0 becomes 0.0
                ordered[role] = np.sort(plain + 0.0 if role == "number" else plain)
        numbers = ordered.get("number", ordered.get("whole"))
        if numbers is not None and len(numbers):
            numbers = numbers.astype(np.float64, copy=False)
            piece._take(numbers)
            self.ranks.add(numbers)
        piece.written = piece.n
        stamps = ordered.get("stamp", ())
        if len(stamps):
            piece.dated = len(stamps)
            self._widen(first=int(stamps[0]), last=int(stamps[-1]))
        if "mark" in cells:
            marks = cells["mark"].drop_null().to_numpy(zero_copy_only=False)
            piece.written = int(np.count_nonzero(marks & NUMERAL))
            self.blanks += int(np.count_nonzero(marks & BLANK))
            lengths = np.sort(marks >> 2)
            if len(lengths):
                self.characters += int(lengths.sum(dtype=np.int64))
                self._widen(shortest=int(lengths[0]), longest=int(lengths[-1]))
                self.lengths.add(lengths.astype(np.float64))
        self.facts.merge(piece)
        if value is None:
            return None
        if value in ordered:
            return _runs(ordered[value])
        words = cells[value]
        if self.longest is not None and self.longest > SHORT:
            words = words.filter(pc.less(cells["mark"], (SHORT + 1) * 4))
        found = pc.value_counts(words.drop_null())
        return found.field("values"), found.field("counts")


def _runs(ordered: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The distinct values of sorted ones, and how often each is there."""
    starts = np.flatnonzero(np.r_[len(ordered) > 0, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[starts, len(ordered)])
    return pa.array(ordered[starts]), pa.array(counts, pa.int64())


def _summed(values: pa.Array, counts: pa.Array, name: str) -> pa.Table:
    table = pa.table({name: values, "count": counts}).group_by(name).aggregate([("count", "sum")])
    return table.select([name, "count_sum"]).combine_chunks()


class _Values:
    """The distinct values of a column in a task: kept and counted while few, else handed on."""

    def __init__(self, role: str) -> None:
        self.role = role
        self.few: pa.Table | None = None
        self.listed = True

    def add(self, values: pa.Array, counts: pa.Array) -> pa.Array | None:
        """Values to hand on now."""
        if not self.listed:
            return values
        if self.few is not None:
            old = [self.few.column(i).combine_chunks() for i in (0, 1)]
            values, counts = pa.concat_arrays([old[0], values]), pa.concat_arrays([old[1], counts])
        self.few = _summed(values, counts, "value")
        if self.few.num_rows < LISTED:
            return None
        self.listed = False
        few, self.few = self.few, None
        return few.column(0).combine_chunks()


def _rows(part: int, position: int, size: int, **cells: object) -> pa.RecordBatch:
    arrays = []
    for own in _SCANNED:
        if own.name in cells:
            cell = cells[own.name]
            arrays.append(cell if cell.type == own.type else cell.cast(own.type))
        elif own.name in ("part", "position"):
            same = part if own.name == "part" else position
            arrays.append(pa.array(np.full(size, same, np.int32)))
        else:
            arrays.append(pa.nulls(size, own.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_SCANNED)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PIECE or size >= PIECE_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def summaries(
    df: DataFrame,
    cells: Mapping[int, Mapping[str, Column]],
    values: Mapping[int, str],
    as_text: Column,
    distinct: Column,
) -> DataFrame:
    """Rows (position, distinct, items, state) from one scan, one per position with rows.

    ``cells`` gives each position what it has of: number (double), whole (long), stamp
    (timestamp_ntz), word (string: a text, or a digest of one longer than SHORT), mark (of a text:
    its length * 4 and what it is), present (else a value is there if not NULL). ``values`` tells
    which of them is the value; ``as_text`` makes a text of it, ``distinct`` sketches column "text".
    """
    positions = list(cells)
    plan = [(pos, role) for pos, own in cells.items() for role in ROLES if role in own]
    wide = df.select(*[cells[pos][role].alias(f"{role}{pos}") for pos, role in plan])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        found = {pos: Summary((part, pos)) for pos in positions}
        seen = {pos: _Values(role) for pos, role in values.items()}
        for piece in _pieces(batches):
            own: dict[int, dict[str, pa.Array]] = {pos: {} for pos in positions}
            for i, (pos, role) in enumerate(plan):
                own[pos][role] = pa.concat_arrays(piece.column(i).chunks)
            for pos, summary in found.items():
                counted = summary.add(piece.num_rows, own[pos], values.get(pos))
                if counted is not None:
                    many = seen[pos].add(*counted)
                    if many is not None and len(many):
                        yield _rows(part, pos, len(many), **{seen[pos].role: many})
                if summary.longest is not None and summary.longest > SHORT:
                    long = pc.greater_equal(own[pos]["mark"], (SHORT + 1) * 4)
                    texts = own[pos]["word"].filter(long).unique()
                    if len(texts):
                        yield _rows(part, pos, len(texts), word=texts)
        for pos, summary in found.items():
            if not summary.facts.total:
                continue
            if pos in seen:
                summary.listed = seen[pos].listed
                few = seen[pos].few
                if few is not None and few.num_rows:
                    listed, counts = (few.column(i).combine_chunks() for i in (0, 1))
                    yield _rows(part, pos, len(listed), **{seen[pos].role: listed}, n=counts)
            yield _rows(part, pos, 1, state=pa.array([summary.state()], _STATE))

    item = F.when(F.col("n").isNotNull(), F.struct(F.col("text").alias("item"), F.col("n").alias("count")))
    together = (
        wide.mapInArrow(scan, f"{_SCAN}, state struct<{STATE}>")
        .withColumn("text", as_text)
        .groupBy("position", F.floor(F.col("part") / TOGETHER).alias("place"))
        .agg(
            distinct.alias("distinct"),
            F.collect_list(item).alias("items"),
            F.collect_list("state").alias("states"),
        )
    )
    return merged(_folded(together.drop("place"), "position int"), "position int")


def merged(rows: DataFrame, keys: str, *alike: Column, place: Column | None = None) -> DataFrame:
    """Summaries of the same first key added up; ``alike`` are aggregates of the other keys.

    With ``place`` there is a row for each of its values, for a first step over many summaries.
    """
    first = [F.col(keys.split()[0])]
    if place is not None:
        first.append(place.alias("place"))
    parts = [
        F.hll_union_agg("distinct").alias("distinct"),
        F.flatten(F.collect_list("items")).alias("items"),
        F.collect_list("state").alias("states"),
    ]
    return _folded(rows.groupBy(*first).agg(*alike, *parts).drop("place"), keys)


def _folded(rows: DataFrame, keys: str) -> DataFrame:
    """Rows (keys, distinct, items, states) with one state each."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, states = [], []
            for i in range(batch.num_rows):
                together = batch.column("states")[i].values
                whole = Summary((len(together),))
                for state in together:
                    whole.merge(Summary.of(state, (0,)))
                listed = None
                if whole.listed:
                    own = batch.column("items")[i].values
                    table = _summed(own.field("item"), own.field("count"), "item")
                    whole.listed = table.num_rows < LISTED
                    if whole.listed:
                        listed = table.rename_columns(["item", "count"]).to_pylist()
                items.append(listed)
                states.append(whole.state())
            own = [batch.column(i) for i in range(batch.num_columns - 2)]
            arrays = [*own, pa.array(items, _ITEMS), pa.array(states, _STATE)]
            names = [*batch.schema.names[:-2], "items", "state"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(fold, f"{keys}, distinct binary, items {ITEMS}, state struct<{STATE}>")

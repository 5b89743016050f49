"""Facts about many columns from one scan.

Each task keeps one accumulator per column: counts, moments, extremes, and the values of a column
as long as they are few and short. Accumulators of parts of the rows add up to the one of all, so
they are merged on the executors in two steps, and the driver sees one row per column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

# values of a column are listed while they are at most so many, and none is longer
LISTED, SHORT = 100, 256
# tasks whose accumulators one step of the merge takes together
TASKS = 1024

# what a cell can tell: see ``column_facts``
ROLES = ("number", "word", "written", "dated", "length", "present")

SCHEMA = (
    "part int, pos int, total long, present long, written long, dated long, longest long, n long,"
    " sum double, mean double, m2 double, m3 double, m4 double, low double, high double, zeros long,"
    " negatives long, integers long, words array<binary>, counts array<long>"
)
_KINDS = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "array<binary>": pa.list_(pa.binary()),
    "array<long>": pa.list_(pa.int64()),
}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in SCHEMA.split(", ")])
_SUMS = ("total", "present", "written", "dated", "zeros", "negatives", "integers")
_MOMENTS = ("n", "sum", "mean", "m2", "m3", "m4", "low", "high")


@dataclass
class Facts:
    """What is known about some rows of a column; ``words`` is None once there are too many."""

    total: int = 0
    present: int = 0
    written: int = 0
    dated: int = 0
    longest: int = 0
    n: int = 0
    sum: float = 0.0
    mean: float = 0.0
    m2: float = 0.0
    m3: float = 0.0
    m4: float = 0.0
    low: float = float("inf")
    high: float = float("-inf")
    zeros: int = 0
    negatives: int = 0
    integers: int = 0
    words: dict[bytes, int] | None = field(default_factory=dict)

    def merge(self, other: Facts) -> None:
        for name in _SUMS:
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.longest = max(self.longest, other.longest)
        self._merge_moments(other)
        self._merge_words(other.words)

    def _merge_moments(self, b: Facts) -> None:
        """Central sums of the union of two disjoint sets (pairwise update formulas)."""
        if not b.n:
            return
        if not self.n:
            for name in _MOMENTS:
                setattr(self, name, getattr(b, name))
            return
        n = self.n + b.n
        with np.errstate(all="ignore"):
            d = np.float64(b.mean) - self.mean
            step, p, q = d / n, float(self.n), float(b.n)
            self.m4 = float(
                self.m4
                + b.m4
                + d * step**3 * p * q * (p * p - p * q + q * q)
                + 6 * step**2 * (p * p * b.m2 + q * q * self.m2)
                + 4 * step * (p * b.m3 - q * self.m3)
            )
            self.m3 = float(
                self.m3
                + b.m3
                + d * step**2 * p * q * (p - q)
                + 3 * step * (p * b.m2 - q * self.m2)
            )
            self.m2 = float(self.m2 + b.m2 + d * step * p * q)
            self.mean = float(self.mean + step * q)
        self.sum += b.sum
        self.n, self.low, self.high = n, min(self.low, b.low), max(self.high, b.high)

    def _merge_words(self, words: dict[bytes, int] | None) -> None:
        if self.words is None or words is None:
            self.words = None
            return
        for word, n in words.items():
            self.words[word] = self.words.get(word, 0) + n
        if len(self.words) > LISTED:
            self.words = None

    def add(self, rows: int, cells: Mapping[str, pa.Array]) -> None:
        """Take in the cells of one batch."""
        for first in ("present", "length", "number", "word"):
            if first in cells:
                cell = cells[first]
                present = cell.true_count if first == "present" else rows - cell.null_count
                break
        batch = Facts(total=rows, present=present)
        if "written" in cells:
            batch.written, batch.dated = cells["written"].true_count, cells["dated"].true_count
            batch.longest = pc.max(cells["length"]).as_py() or 0
        if "number" in cells:
            batch._take(cells["number"].drop_null().to_numpy(zero_copy_only=False))
        if "word" in cells and self.words is not None:
            counted = pc.value_counts(cells["word"].drop_null())
            if len(counted) > LISTED:
                batch.words = None
            else:
                batch.words = {w["values"]: w["counts"] for w in counted.to_pylist()}
        self.merge(batch)

    def _take(self, v: np.ndarray) -> None:
        if not len(v):
            return
        v = v + 0.0  # -0.0 becomes 0.0
        self.n, self.low, self.high = len(v), float(v.min()), float(v.max())
        self.zeros, self.negatives = int((v == 0).sum()), int((v < 0).sum())
        self.integers = int((v == np.floor(v)).sum())
        if self.low == self.high:
            self.sum, self.mean = self.n * self.low, self.low  # a mean by division could miss it, and leave a spread
            return
        with np.errstate(all="ignore"):
            self.sum = float(v.sum())
            self.mean = self.sum / self.n
            d = v - self.mean
            square = d * d
            self.m2 = float(square.sum())
            self.m3, self.m4 = float((square * d).sum()), float((square * square).sum())

    def moments(self) -> dict[str, object]:
        """The numbers as the aggregate functions of the same names would give them."""
        spread = self.m2 > 0
        with np.errstate(all="ignore"):
            m2 = np.float64(self.m2)
            shape = float(np.sqrt(np.float64(self.n)) * self.m3 / (m2 * np.sqrt(m2))) if spread else None
            tails = float(self.n * self.m4 / (m2 * m2) - 3) if spread else None
        return {
            "n_valid": self.n,
            # a sum of whole numbers has no error, so a mean of 0 is 0
            "mean": self.sum / self.n if self.n and self.low < self.high else self.mean,
            "std": float(np.sqrt(self.m2 / (self.n - 1))) if self.n > 1 else None,
            "min": self.low,
            "max": self.high,
            "skewness": shape,
            "kurtosis": tails,
            "zero_count": self.zeros,
            "negative_count": self.negatives,
            "all_integers": self.integers == self.n,
        }

    def texts(self) -> dict[str, int] | None:
        """All values with their counts, if they are few, short and proper text."""
        if self.words is None or self.longest > SHORT:
            return None
        try:
            return {word.decode(): n for word, n in self.words.items()}
        except UnicodeDecodeError:
            return None


_NAMES = [f.name for f in fields(Facts) if f.name != "words"]


def _rows(found: Mapping[tuple[int, int], Facts]) -> pa.RecordBatch:
    rows = []
    for (part, pos), facts in found.items():
        row = asdict(facts) | {"part": part, "pos": pos}
        words = row.pop("words")
        row["words"] = None if words is None else list(words)
        row["counts"] = None if words is None else list(words.values())
        rows.append(row)
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _facts(row: Mapping[str, object]) -> Facts:
    facts = Facts(**{name: row[name] for name in _NAMES})
    words = row["words"]
    facts.words = None if words is None else dict(zip(map(bytes, words), row["counts"], strict=True))
    return facts


def _merged(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One accumulator per column and group of ``size`` parts; a group's rows come one by one."""
    found: dict[tuple[int, int], Facts] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["part"] // size, row["pos"])
            found.setdefault(key, Facts()).merge(_facts(row))
    if found:
        yield _rows(found)


def column_facts(df: DataFrame, cells: Mapping[int, Mapping[str, Column]]) -> dict[int, Facts]:
    """Facts by position. ``cells`` gives each column what it has of these:

    number (double), word (binary: a value to list, NULL if it is long), written (is it a written
    number), dated (does it begin like a date; both come with length), length (of a text), present
    (else a cell of the column says by not being NULL that the value is there).
    """
    positions = list(cells)
    plan = [(pos, role) for pos, own in cells.items() for role in ROLES if role in own]
    wide = df.select(*[cells[pos][role].alias(f"{role}{pos}") for pos, role in plan])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {pos: Facts() for pos in positions}
        for batch in batches:
            own: dict[int, dict[str, pa.Array]] = {pos: {} for pos in positions}
            for i, (pos, role) in enumerate(plan):
                own[pos][role] = batch.column(i)
            for pos, facts in found.items():
                facts.add(batch.num_rows, own[pos])
        part = TaskContext.get().partitionId()
        yield _rows({(part, pos): facts for pos, facts in found.items() if facts.total})

    def step(rows: DataFrame, size: int) -> DataFrame:
        place = F.floor(F.col("part") / size)
        return rows.repartition("pos", place).mapInArrow(lambda b: _merged(b, size), SCHEMA)

    whole = step(step(wide.mapInArrow(scan, SCHEMA), TASKS), 1 << 30)
    return {row["pos"]: _facts(row.asDict()) for row in whole.collect()}

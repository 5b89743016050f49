"""Word shingles of many texts at once, as 64-bit hashes in arrays."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_CHARS = 1_000_000
TABLE_WORDS = 200_000
WIDTH = 5

find_words: Callable[[str], list[str]] = re.compile(r"[^\x20\x09-\x0D]+").findall

_MULTIPLY = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SHIFT = (np.uint64(30), np.uint64(27), np.uint64(31))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _SHIFT[0])) * _MULTIPLY[0]
    x = (x ^ (x >> _SHIFT[1])) * _MULTIPLY[1]
    return x ^ (x >> _SHIFT[2])


def slices(lengths: Sequence[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``most`` characters in all."""
    start, chars = 0, 0
    for i, length in enumerate(lengths):
        chars += length
        if chars >= most:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of texts of about SLICE_CHARS bytes: bounds and texts; only one run is in Python."""
    for a, b in slices(pc.binary_length(column).to_pylist()):
        yield a, b, column.slice(a, b - a).to_pylist()


class WordHashes:
    """64-bit hashes of words; keeps those it has met, up to a bound."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.hashes = np.empty(0, np.uint64)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.places) > TABLE_WORDS:
            self.clear()
        new = list(set(words).difference(self.places))
        if new:
            first = len(self.places)
            self.places.update(zip(new, range(first, first + len(new)), strict=True))
            fresh = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, fresh])
        places = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        return self.hashes[places]


def shingle_hashes(
    words: np.ndarray, counts: np.ndarray, width: int = WIDTH
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the number of shingles of each text.

    ``words`` are the word hashes of all texts one after the other, ``counts`` their numbers. A text
    of fewer words than ``width`` is one shingle, a text without words has none.
    """
    counts = np.asarray(counts, np.int64)
    sizes = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    # the first word of each shingle: the place of its text, then one after the other
    starts = np.repeat(np.cumsum(counts) - counts - (np.cumsum(sizes) - sizes), sizes)
    starts += np.arange(len(starts))
    out = np.zeros(len(starts), np.uint64)
    short = np.repeat(counts < width, sizes)
    first = starts[short]
    lengths = counts[(counts > 0) & (counts < width)]
    whole = np.zeros(len(first), np.uint64)
    for k in range(width):
        inside = k < lengths
        whole[inside] = scramble(whole[inside] ^ words[first[inside] + k]) + np.uint64(k + 1)
        out ^= words[np.minimum(starts + k, len(words) - 1)]
        out = scramble(out)
        out += np.uint64(k + 1)
    out[short] = whole
    return out, sizes

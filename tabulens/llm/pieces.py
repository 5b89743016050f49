"""SentencePiece encoding and decoding through a table of distinct marked words.

The library writes a blank as a marker and puts one marker in front of a text. Where no piece holds
a marker behind another character, no merge can cross from a word into the next marker, so a text
falls apart, before every run of markers, into chunks that are segmented alone. Each task keeps a
table of the distinct chunks it has met: a chunk is segmented once, texts become positions in that
table, and their ids are the table's ids taken by position. The table is emptied when it is full.

The table is kept per task on purpose. One table for the corpus would be joined to every position
of every text: over the 0.5 GB check input that is 133 million rows of (document, position, chunk)
and twice as many to order them again, several times the input on disk, to save the segmentation of
words that more than one task meets, which is a few seconds of the whole.

A vocabulary with pieces that cross markers, or a normaliser that changes or removes characters, is
found when the model is loaded; whole texts are segmented then.

Defined cases: null and empty texts have no ids; no ids decode to an empty text; rows are
independent of each other, so repeated rows and ids do not matter; extra columns are kept, an input
column named like a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import whole

MARKER = "▁"
# Distinct chunks kept by a task, and characters of text taken at a time.
TABLE_CHUNKS = 200_000
SLICE_CHARS = 1_000_000


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def chunks_are_safe(processor) -> bool:
    """Whether texts may be cut before every run of markers."""
    crossing = re.compile(f"[^{MARKER}]{MARKER}")
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    probe = "  a  b éﬁ①　\t\n"
    unchanged = processor.normalize(probe) == MARKER + probe.replace(" ", MARKER)
    return unchanged and not any(crossing.search(p) for p in pieces)


class ChunkTable:
    """Distinct chunks of one task with their ids, in arrays that positions point into."""

    def __init__(self, processor):
        self.processor = processor
        self.split = re.compile(f"{MARKER}+[^{MARKER}]*").findall
        # a marker that ends a text: an empty text has no ids, so it is read behind another one
        self.lone = processor.encode("a ")[len(processor.encode("a")) :]
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _add(self, chunks: list[str]) -> None:
        """Segment new chunks; the first marker is the one that the library adds itself."""
        segmented = self.processor.encode(
            [c[1:].replace(MARKER, " ") for c in chunks], num_threads=1
        )
        segmented = [ids if c != MARKER else self.lone for c, ids in zip(chunks, segmented)]
        lengths = np.fromiter(map(len, segmented), np.int64, len(segmented))
        flat = np.fromiter((i for ids in segmented for i in ids), np.int32, int(lengths.sum()))
        self.places.update(zip(chunks, range(len(self.places), len(self.places) + len(chunks))))
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        if len(self.places) > TABLE_CHUNKS:
            self.clear()
        chunked = [self.split(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        new = {c for chunks in chunked for c in chunks}.difference(self.places)
        if new:
            self._add(sorted(new))
        counts = np.fromiter(map(len, chunked), np.int64, len(chunked))
        places = np.fromiter(
            (p for chunks in chunked for p in map(self.places.__getitem__, chunks)),
            np.int64,
            int(counts.sum()),
        )
        lengths = self.starts[places + 1] - self.starts[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        # position of every id in the table: its chunk's start, and how far it is into the chunk
        taken = np.arange(total) + np.repeat(self.starts[places] - (ends - lengths), lengths)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], ends])[bounds]
        return self.ids[taken], np.diff(upto)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about SLICE_CHARS characters."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= SLICE_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encoder(model: str):
    """A function of a list of texts to their ids as an Arrow list array."""
    processor = load(model)
    table = ChunkTable(processor) if chunks_are_safe(processor) else None

    def run(texts: list[str]) -> pa.Array:
        ids, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for a, b in _slices(texts):
            if table is not None:
                own, lengths = table.encode(texts[a:b])
            else:
                lists = processor.encode(texts[a:b], num_threads=1)
                lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                own = np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum()))
            ids.append(own)
            counts.append(lengths)
        offsets = pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))

    return run


def _decoder(model: str):
    """A function of an Arrow list array of ids to an array of texts."""
    processor = load(model)

    def run(ids: pa.Array) -> pa.Array:
        texts = (processor.decode(x.as_py()) if x.is_valid else "" for x in ids)
        return pa.array(texts, pa.string())

    return run


def encode(df: DataFrame, model: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with the ids of each text, without begin or end ids."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoded = _encoder(model)
        for batch in batches:
            yield encoded(batch.to_pylist())

    return df.withColumn(to, run(whole(text_col)))


def decode(df: DataFrame, model: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoded = _decoder(model)
        for batch in batches:
            yield decoded(batch)

    return df.withColumn(to, run(F.col(f"`{ids_col}`")))


def encode_and_decode(
    df: DataFrame, model: str, text_col: str = "text", to: str = "coded"
) -> DataFrame:
    """``df`` with a struct of the ids of each text and the text that they decode to.

    The same as ``decode`` of ``encode``, in one Python process for each task.
    """

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoded, decoded = _encoder(model), _decoder(model)
        for batch in batches:
            ids = encoded(batch.to_pylist())
            yield pa.StructArray.from_arrays([ids, decoded(ids)], names=["ids", "decoded"])

    return df.withColumn(to, run(whole(text_col)))

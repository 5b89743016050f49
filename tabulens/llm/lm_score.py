"""Language-model scoring by a weighted backoff automaton over smoothed n-grams.

Tokens are words with A-Z in lower case, then one end per text. All n-grams of up to ORDER tokens of
the training texts are counted, single ones too; a text begins in a context of its own. With c(h)
the number of tokens after a context h, and h' the context without its first word,

    p(w | h) = (c(h w) + SMOOTH * p(w | h')) / (c(h) + SMOOTH)          (Dirichlet smoothing)

and p(w) = (c(w) + ADD) / (N + ADD * (V + 1)) below all contexts. A pair of words is a context from
MIN occurrences on; below that its second word alone is the context. So every context sums to 1.

As an automaton: a state is a context, an arc a counted n-gram with its log10 probability, leading
to the longest context at its end; a failure arc leads to the shorter context with the log10 of
what the state leaves to it, SMOOTH / (c(h) + SMOOTH). A token follows its arc, over as many
failure arcs as there are on the way; the root has an arc for every token. ``Automaton.walk`` goes
through all texts of a slice together from left to right, a state each; a long text is cut, and each
piece first walks the ORDER - 1 tokens before it, which is all that a state remembers.

How it runs:

1. Texts are read once and become slices of SLICE_BYTES: the 64-bit hashes of their distinct words
   and the texts as numbers of these, packed. They are dealt to tasks by slice and stay there
   (checkpointed), so later steps do not move them again.
2. Each slice asks for the totals of its distinct words and pairs: it sends the keys, sorted and
   packed (about six bytes a key, a row for each range of keys), with its own training counts. A task
   per range adds up what all slices sent and answers each with the totals of its keys alone, in
   their order. So one exchange both counts the corpus and looks up what a slice needs.
3. With these answers each slice asks for the triples after its frequent pairs, in the same way.
4. Each slice builds the automaton of its own n-grams and walks its texts.

Nothing is collected but the numbers of tokens, words and texts, and nothing is broadcast. A task
holds a slice and its n-grams, or a range of RANGE_KEYS keys. A frequent n-gram is one key of a
slice, so no key is hot.

Defined cases: null and empty texts are one token, the end; without training texts every token has
probability 1; repeated rows are texts of their own, for training too; a text longer than a slice
is a slice; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import scramble, text_slices
from .store import Store, pin_dealt
from .texts import whole

ORDER = 3
ADD = 0.1
# weight of the shorter context, for contexts of one word and of two
SMOOTH = (0.0, 20.0, 5.0)
# occurrences from which on a pair of words is a context
MIN = 3
# bytes of text in a slice, distinct words that a reader keeps, keys in a range
SLICE_BYTES = 8_000_000
TABLE_WORDS = 200_000
RANGE_KEYS = 2_000_000
# tokens that one walker goes through, ORDER - 1 at least
WALK = 256

_words = re.compile(rb"[^\x20\x09-\x0D]+").findall
# begin and end of a text are no words: they hold a blank
_BEGIN = np.uint64(xxhash.xxh64_intdigest(b" begin"))
_END = np.uint64(xxhash.xxh64_intdigest(b" end"))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Reader:
    """Turns texts into hashes of words, keeping those it has met."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.hashes = np.array([_END])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every token of the texts one after the other; tokens of each."""
        if len(self.places) > TABLE_WORDS:
            self.clear()
        words = [_words(t.encode().lower()) for t in texts]
        new = list({w for own in words for w in own}.difference(self.places))
        if new:
            first = len(self.hashes)
            self.places.update(zip(new, range(first, first + len(new)), strict=True))
            fresh = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, fresh])
        counts = np.fromiter(map(len, words), np.int64, len(words)) + 1
        index = np.zeros(int(counts.sum()), np.int64)  # 0 is the end
        inside = np.ones(len(index), bool)
        inside[np.cumsum(counts) - 1] = False
        get = self.places.__getitem__
        index[inside] = np.fromiter(
            (p for own in words for p in map(get, own)), np.int64, int(inside.sum())
        )
        return self.hashes[index], counts


def _longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the n-gram of a context and a word."""
    return scramble(scramble(context + _STEP) ^ word)


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte of their value: small ones take little."""
    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return struct.pack("<q", len(numbers)) + pa.compress(
        planes.tobytes(), codec="zstd", asbytes=True
    )


def unpack(blob: bytes) -> np.ndarray:
    count = struct.unpack_from("<q", blob)[0]
    raw = pa.decompress(blob[8:], decompressed_size=8 * count, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(8, count)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


@dataclass
class Slice:
    """Some texts as numbers of their distinct words."""

    vocab: np.ndarray  # hashes
    words: np.ndarray  # number of the word of every token, texts one after the other
    counts: np.ndarray  # tokens of each text
    held: np.ndarray  # whether the text is held out

    @classmethod
    def of(cls, row: pa.Table) -> Slice:
        return cls(
            unpack(row["vocab"][0].as_py()),
            unpack(row["words"][0].as_py()).astype(np.int64),
            row["counts"][0].values.to_numpy(zero_copy_only=False).astype(np.int64),
            row["held"][0].values.to_numpy(zero_copy_only=False).astype(bool),
        )

    def __post_init__(self):
        starts = np.cumsum(self.counts) - self.counts
        self.first = np.zeros(len(self.words), bool)
        self.first[starts] = True
        self.training = np.repeat(~self.held, self.counts)
        hashes = self.vocab[self.words]
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        before[starts] = _BEGIN
        self.pairs = _longer(before, hashes)
        self.hashes = hashes

    def triples(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that end a triple after a frequent pair, and the triples' hashes.

        ``totals`` has the total of the pair that ends at each place.
        """
        place = np.nonzero(~self.first)[0]
        place = place[totals[place - 1] >= MIN]
        return place, _longer(self.pairs[place - 1], self.hashes[place])


def _slices(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each slice: the ids of its texts, and the texts packed."""
    reader = Reader()
    number = TaskContext.get().partitionId() << 32
    ids: list[pa.Array] = []
    held: list[pa.Array] = []
    counts: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal number, size
        tokens = np.concatenate(hashes)
        vocab, inverse, times = np.unique(tokens, return_inverse=True, return_counts=True)
        # frequent words get small numbers
        rank = np.argsort(-times, kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        own = np.concatenate(counts)
        out = pa.concat_arrays(held)
        train = ~out.to_numpy(zero_copy_only=False).astype(bool)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.concat_arrays(ids)),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), out),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own)),
                pa.array([int(own[train].sum())], pa.int64()),
                pa.array([int(train.sum())], pa.int64()),
                pa.array([len(tokens)], pa.int64()),
                pa.array([pack(vocab[rank])], pa.binary()),
                pa.array([pack(place[inverse])], pa.binary()),
            ],
            names=["slice", "ids", "held", "counts", "train", "texts", "tokens", "vocab", "words"],
        )
        for kept in (ids, held, counts, hashes):
            kept.clear()
        number, size = number + 1, 0
        return batch

    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_pylist()
        start = 0
        for i, length in enumerate(lengths):
            full = size and size + length > SLICE_BYTES
            last = i + 1 == len(lengths)
            for stop in ([i] if full else []) + ([i + 1] if last else []):
                if stop > start:
                    part = batch.slice(start, stop - start)
                    ids.append(part.column("id").cast(id_type))
                    held.append(part.column("held_out"))
                    for _, _, texts in text_slices(part.column("text")):
                        found, own = reader(texts)
                        hashes.append(found)
                        counts.append(own)
                start = stop
                if stop == i and full and counts:
                    yield flush()
            size += length + 1
    if counts:
        yield flush()


ASK = "n int, range long, slice long, keys binary, own binary"
ANSWER = "n int, range long, slice long, totals binary, distinct long"


def _ask(n: int, number: int, keys: np.ndarray, training: np.ndarray, bits: int) -> pa.RecordBatch:
    """The distinct keys with their training counts, a row for each range of keys."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    own = np.bincount(inverse, training, len(distinct)).astype(np.int64)
    ranges = (distinct >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.nonzero(np.diff(ranges, prepend=-1))[0]
    stops = np.append(starts[1:], len(distinct))
    steps = [np.diff(distinct[a:b], prepend=np.uint64(0)) for a, b in zip(starts, stops)]
    many = len(starts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(many, n, np.int32)),
            pa.array(ranges[starts]),
            pa.array(np.full(many, number, np.int64)),
            pa.array([pack(s) for s in steps], pa.binary()),
            pa.array([pack(own[a:b]) for a, b in zip(starts, stops)], pa.binary()),
        ],
        names=["n", "range", "slice", "keys", "own"],
    )


def _answer(asked: pa.Table) -> pa.Table:
    """Adds up a range: to each slice the totals of the keys it asked for."""
    keys = [np.cumsum(unpack(k), dtype=np.uint64) for k in asked["keys"].to_pylist()]
    own = [unpack(k) for k in asked["own"].to_pylist()]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, np.concatenate(own)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, keys)])
    parts = [pack(totals[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    # the number of trained keys goes with one of the answers
    distinct = np.zeros(len(asked), np.int64)
    distinct[0] = np.count_nonzero(totals)
    return pa.Table.from_arrays(
        [asked["n"], asked["range"], asked["slice"], pa.array(parts, pa.binary()), pa.array(distinct)],
        names=["n", "range", "slice", "totals", "distinct"],
    )


def _totals(answers: pa.Table, n: int, keys: np.ndarray) -> np.ndarray:
    """The total of each of the keys that were asked for, from the answers of all ranges."""
    own = answers.filter(pc.equal(answers["n"], n)).sort_by("range")
    if not len(own):
        return np.zeros(len(keys), np.int64)
    distinct = np.concatenate([unpack(t) for t in own["totals"].to_pylist()]).astype(np.int64)
    return distinct[np.unique(keys, return_inverse=True)[1]]


@dataclass
class Automaton:
    """States, arcs and failure arcs of the n-grams of a slice.

    States: 0 the root, then one for each word, one for the begin of a text, one for each frequent
    pair. ``keys`` are the arcs, state * width + word, sorted.
    """

    width: int
    begin: int
    keys: np.ndarray
    logs: np.ndarray
    targets: np.ndarray
    # failure arcs
    lower: np.ndarray
    backoff: np.ndarray
    # arcs of the root
    root_logs: np.ndarray
    root_targets: np.ndarray

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more token each, and the log10 probabilities of the tokens."""
        logs = np.zeros(len(words))
        after = np.empty_like(states)
        left = np.arange(len(words))
        now = states.copy()
        while len(left):
            at_root = now == 0
            ended = left[at_root]
            logs[ended] += self.root_logs[words[ended]]
            after[ended] = self.root_targets[words[ended]]
            left, now = left[~at_root], now[~at_root]
            if not len(left) or not len(self.keys):
                logs[left] += self.backoff[now]
                now = self.lower[now]
                continue
            key = now * self.width + words[left]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            logs[left[found]] += self.logs[arc[found]]
            after[left[found]] = self.targets[arc[found]]
            left, now = left[~found], now[~found]
            logs[left] += self.backoff[now]
            now = self.lower[now]
        return after, logs

    def walk(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 probability of every text, all of them from left to right together."""
        starts = np.cumsum(counts) - counts
        pieces = -(-counts // WALK)
        text = np.repeat(np.arange(len(counts)), pieces)
        inside = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WALK
        start = starts[text] + inside
        length = np.minimum(counts[text] - inside, WALK)
        states = np.where(inside == 0, self.begin, 0)
        later = np.nonzero(inside)[0]
        for back in range(ORDER - 1, 0, -1):
            states[later], _ = self.step(states[later], words[start[later] - back])
        scores = np.zeros(len(text))
        # the longest pieces first, so that those still walking are the first ones
        order = np.argsort(-length, kind="stable")
        start, states, ends = start[order], states[order], -length[order]
        for k in range(int(length.max(initial=0))):
            going = int(np.searchsorted(ends, -k, side="left"))
            states[:going], logs = self.step(states[:going], words[start[:going] + k])
            scores[order[:going]] += logs
        return np.bincount(text, scores, len(counts))


def build(own: Slice, answers: pa.Table, total: float, texts: int) -> tuple[Automaton, np.ndarray]:
    """The automaton of a slice, and the total of every token's word."""
    c1 = _totals(answers, 1, own.vocab)  # by number of the word
    pair, at, which = np.unique(own.pairs, return_index=True, return_inverse=True)
    c2_token = _totals(answers, 2, own.pairs)
    c2 = c2_token[at]
    width = len(own.vocab)
    begin = width + 1
    end = own.vocab == _END
    p1 = (c1 + ADD) / total

    # contexts: the root, words, the begin, frequent pairs
    frequent = np.nonzero((c2 >= MIN) & ~end[own.words[at]])[0]
    pair_state = np.zeros(len(pair), np.int64)
    pair_state[frequent] = begin + 1 + np.arange(len(frequent))
    known = (c1 > 0) & ~end
    size = np.concatenate([[0], np.where(known, c1, 0), [texts], c2[frequent]]).astype(float)
    level = np.concatenate([[0], np.ones(width + 1, int), np.full(len(frequent), 2)])
    lower = np.zeros(len(size), np.int64)
    word_state = np.where(known, np.arange(1, width + 1), 0)
    lower[begin + 1 :] = word_state[own.words[at[frequent]]]
    smooth = np.array(SMOOTH)[level]
    leave = np.where(size > 0, smooth / np.maximum(size + smooth, 1e-300), 1.0)
    leave[0] = 1.0

    # arcs of words and the begin: pairs
    word = own.words[at]
    before = np.where(own.first[at], begin, word_state[own.words[np.maximum(at - 1, 0)]])
    trained = (c2 > 0) & (before > 0)
    p2 = np.zeros(len(pair))
    k = SMOOTH[1]
    p2[trained] = (c2[trained] + k * p1[word[trained]]) / (size[before[trained]] + k)
    target = np.where(pair_state > 0, pair_state, word_state[word])
    keys, logs, targets = [before[trained] * width + word[trained]], [p2[trained]], [target[trained]]

    # arcs of frequent pairs: triples
    place, triples = own.triples(c2_token)
    if len(place):
        c3 = _totals(answers, 3, triples)
        _, once = np.unique(triples, return_index=True)
        once = once[c3[once] > 0]
        place, c3 = place[once], c3[once]
        state = pair_state[which[place - 1]]
        last = which[place]
        k = SMOOTH[2]
        keys.append(state * width + own.words[place])
        logs.append((c3 + k * p2[last]) / (size[state] + k))
        targets.append(target[last])
    every = np.concatenate(keys)
    order = np.argsort(every)
    with np.errstate(divide="ignore"):
        automaton = Automaton(
            width,
            begin,
            every[order],
            np.log10(np.concatenate(logs))[order],
            np.concatenate(targets)[order],
            lower,
            np.log10(leave),
            np.log10(p1),
            word_state,
        )
    return automaton, c1[own.words]


def _score(rows: pa.Table, answers: pa.Table, total: float, texts: int) -> pa.Table:
    """Tokens and sums of every text of a slice."""
    own = Slice.of(rows)
    automaton, c1 = build(own, answers, total, texts)
    text = np.repeat(np.arange(len(own.counts)), own.counts)
    known = np.bincount(text, c1 > 0, len(own.counts)).astype(np.int64)
    base = np.bincount(text, np.log10((c1 + ADD) / total), len(own.counts))
    return pa.Table.from_arrays(
        [
            rows["ids"].combine_chunks().flatten(),
            pa.array(own.held),
            pa.array(own.counts),
            pa.array(known),
            pa.array(base),
            pa.array(automaton.walk(own.words, own.counts)),
        ],
        names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
    )


def _ask_triples(rows: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    own = Slice.of(rows)
    place, triples = own.triples(_totals(answers, 2, own.pairs))
    number = rows["slice"][0].as_py()
    return pa.Table.from_batches([_ask(3, number, triples, own.training[place], bits)])


def score_texts(
    df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows where ``held_out`` is false.
    """
    spark = df.sparkSession
    store = Store(spark, "lm")
    texts = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        whole(text_col).alias("text"),
    )
    kind = texts.schema["id"].dataType.simpleString()
    id_type = texts.select("id").limit(0).toArrow().schema.field("id").type
    schema = (
        f"slice long, ids array<{kind}>, held array<boolean>, counts array<long>, train long, "
        "texts long, tokens long, vocab binary, words binary"
    )
    # dealt by slice before they are written: grouping by slice moves them no more
    slices = pin_dealt(texts.mapInArrow(lambda b: _slices(b, id_type), schema), "slice")
    facts = slices.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train", "texts", "tokens"))
    ).first()
    bits = max((facts.tokens // RANGE_KEYS).bit_length(), 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                own, number = Slice.of(row), row["slice"][0].as_py()
                yield _ask(1, number, own.hashes, own.training, bits)
                yield _ask(2, number, own.pairs, own.training, bits)

    def answered(asked: DataFrame) -> DataFrame:
        return asked.groupBy("n", "range").applyInArrow(_answer, ANSWER)

    first = store.keep(answered(slices.mapInArrow(ask, ASK)), "words-and-pairs")
    distinct = first.where("n = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first().v
    total = facts.train + ADD * (distinct + 1)
    of_pairs = first.where("n = 2")
    triples = answered(
        slices.groupBy("slice")
        .cogroup(of_pairs.groupBy("slice"))
        .applyInArrow(lambda rows, got: _ask_triples(rows, got, bits), ASK)
    )
    texts_trained = facts.texts
    scored = (
        slices.groupBy("slice")
        .cogroup(first.unionByName(triples).groupBy("slice"))
        .applyInArrow(
            lambda rows, got: _score(rows, got, total, texts_trained),
            f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, "
            "score double",
        )
    )
    return scored.select(
        "id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(facts.train).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )

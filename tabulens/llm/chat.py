"""Chat formatting by a finite-state machine over roles.

A template declares the marks around a turn, the roles whose text is trained on, and which role may
follow which state. The machine walks each conversation once, turn by turn, and emits for every
turn its segments (open mark, text, close mark) with a loss flag each, and whether the turn was
allowed where it stands. Formatted text is the segments one after the other.

Control strings inside texts are escaped: in every ``<\\...\\|`` one more backslash is put between
``<`` and ``|`` (also where there is none yet), so that no text contains a mark and taking one
backslash away restores it. Roles are escaped too, with line breaks and backslashes as ``\\n`` and
``\\\\``.

How it runs: turns are dealt by a hash of the conversation, sorted, and streamed through a Python
function that holds one turn and the machine's state. A conversation of any length is never
gathered; it is read by one task, since each state needs the one before.

Defined cases: a null text or role is empty; turns that tie are ordered by role, then text (null
first); a null turn comes first; rows without a conversation id form one conversation; a repeated
row is a turn of its own; extra columns do not matter; an empty table gives an empty table; a turn
out of order is formatted and flagged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Turns in one batch of Python rows.
BATCH = 256


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles are trained on, and the order they may come in."""

    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    # state -> roles that may come next; the role is the next state
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})


CHATML = Template()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    plain = {"\\\\": "\\", "\\n": "\n"}
    return re.sub(r"\\[\\n]", lambda m: plain[m[0]], unescape(role))


class Machine:
    """State of one conversation: the last role, whether all turns were allowed so far."""

    def __init__(self, template: Template):
        self.template, self.state, self.position, self.valid = template, template.start, 0, True

    def turn(self, role: str, text: str) -> dict:
        t = self.template
        allowed = role in t.moves.get(self.state, ())
        self.valid = self.valid and allowed
        self.state, self.position = role, self.position + 1
        segments = [
            {"text": t.open.format(role=escape_role(role)), "loss": False},
            {"text": escape(text), "loss": role in t.loss_roles},
            {"text": t.close, "loss": False},
        ]
        return {
            "position": self.position,
            "role": role,
            "allowed": allowed,
            "complete": self.valid and role in t.final,
            "segments": segments,
        }


SEGMENTS = "array<struct<text:string,loss:boolean>>"
_SEGMENT_TYPE = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield from batch.slice(start, BATCH).to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_chats(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = CHATML,
) -> DataFrame:
    """One row per turn: conv_id, position, role, allowed, complete, segments (text, loss).

    ``complete`` says that the conversation up to this turn kept the order and may end here. The
    rows of a conversation are in one partition, in order.
    """
    turns = df.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()),
            ("allowed", pa.bool_()), ("complete", pa.bool_()), ("segments", _SEGMENT_TYPE),
        ]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted() -> Iterator[dict]:
            machine, current = None, None
            for row in _rows(batches):
                if machine is None or row["conv_id"] != current:
                    machine, current = Machine(template), row["conv_id"]
                yield {"conv_id": current, **machine.turn(row["role"], row["text"])}

        return _batched(emitted(), schema)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(
        walk,
        "conv_id long, position long, role string, allowed boolean, complete boolean, "
        f"segments {SEGMENTS}",
    )


class Reader:
    """Reads turns back from formatted segments, knowing nothing but the template."""

    def __init__(self, template: Template):
        self.head, self.tail = template.open.split("{role}")
        self.close = template.close
        self.held = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.held += text
        while (end := self.held.find(self.close)) >= 0:
            if not self.held.startswith(self.head):
                raise ValueError("formatted text does not start with a turn")
            role, _, body = self.held[len(self.head) : end].partition(self.tail)
            yield unescape_role(role), unescape(body)
            self.held = self.held[end + len(self.close) :]


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation, from the segments alone: counts and digests of what they say.

    ``formatted`` must hold each conversation in one partition and in order, as format_chats leaves
    it. Digests grow turn by turn, nothing is gathered.
    """
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("complete", pa.bool_()),
        ]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted() -> Iterator[dict]:
            out, reader = None, None

            def closed() -> dict:
                return out | {k: out[k].hexdigest() for k in ("turns_sha256", "loss_sha256")}

            for row in _rows(batches):
                if out is None or row["conv_id"] != out["conv_id"]:
                    if out is not None:
                        yield closed()
                    reader = Reader(template)
                    out = {
                        "conv_id": row["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(),
                        "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0,
                        "valid": True, "complete": False,
                    }
                out["valid"] = out["valid"] and row["allowed"]
                out["complete"] = row["complete"]
                for segment in row["segments"]:
                    out["formatted_chars"] += len(segment["text"])
                    if segment["loss"]:
                        plain = unescape(segment["text"])
                        out["loss_chars"] += len(plain)
                        out["loss_sha256"].update(plain.encode())
                    for role, text in reader.feed(segment["text"]):
                        out["n_turns"] += 1
                        out["turns_sha256"].update(f"{role}\n{text}\n".encode())
            if out is not None:
                yield closed()

        return _batched(emitted(), schema)

    return formatted.mapInArrow(
        walk,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean, complete boolean",
    )

"""Chat formatting: a state machine over roles checks the order of turns and emits text segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template, declared: the segments of a turn and whether they bear loss. ``role`` and ``text`` are filled
#: in with control strings escaped; ``text`` bears loss for the roles listed.
TEMPLATE = {
    "segments": (("<|im_start|>", False), ("{role}", False), ("\n", False), ("{text}", "by_role"), ("<|im_end|>\n", False)),
    "loss_roles": ("assistant",),
}
#: state -> role -> next state; a role without an entry leads to ``invalid``, and the machine goes on from there
#: as if it had been expected.
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user", "tool": "tool"},
    "tool": {"assistant": "assistant"},
}
SEGMENTS = "conv_id long, place long, turn long, valid boolean, segments array<struct<text:string,loss:boolean>>"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "valid boolean"
)


def escape(text: str, line: bool = False) -> str:
    """No control string can stand in the result: ``<|`` becomes ``<\\|``, a backslash two; in a line ``\\n`` too."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str, line: bool = False) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if line and m[1] == "n" else m[1], text, flags=re.S)


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition and in order; equal turns by role and text, null first."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                text("role").alias("role"), text("text").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(conversations: DataFrame, template=TEMPLATE, machine=MACHINE) -> DataFrame:
    """One row per turn: its segments with loss flags, its place from 0, and whether its role was expected.

    Null roles and texts are empty, rows without a conv_id form one conversation, repeated rows are turns of
    their own. Every row is formatted, expected or not. Rows pass one by one with the machine's state alone in
    memory, so a conversation of any length fits; one conversation is one task's, as its order demands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, place = object(), "start", 0
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    now, state, place = conv, "start", 0
                after = machine.get(state, {}).get(role)
                segments = []
                for pattern, loss in template["segments"]:
                    body = {"{role}": escape(role, True), "{text}": escape(text)}.get(pattern, pattern)
                    segments.append({"text": body, "loss": role in template["loss_roles"] if loss == "by_role" else loss})
                out.append({"conv_id": conv, "place": place, "turn": turn, "valid": after is not None, "segments": segments})
                state, place = after or (role if role in machine else state), place + 1
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return _ordered(conversations).mapInArrow(run, SEGMENTS)


_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("valid", pa.bool_()),
    ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
])


class Reader:
    """Reads formatted text back, turn by turn, knowing the control strings alone."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars, self.valid = conv, 0, 0, 0, True
        self.all, self.loss, self.rest = hashlib.sha256(), hashlib.sha256(), ""

    def feed(self, segments: list[dict], valid: bool) -> None:
        text = "".join(s["text"] for s in segments)
        self.chars += len(text)
        self.valid &= valid
        self.rest += text
        while (end := self.rest.find("<|im_end|>\n")) >= 0:
            if not self.rest.startswith("<|im_start|>"):
                raise ValueError("a turn without its mark")
            role, _, body = self.rest[len("<|im_start|>"):end].partition("\n")
            self.all.update(f"{unescape(role, True)}\n{unescape(body)}\n".encode())
            self.turns += 1
            self.rest = self.rest[end + len("<|im_end|>\n"):]
        under = unescape("".join(s["text"] for s in segments if s["loss"]))
        self.loss_chars += len(under)
        self.loss.update(under.encode())

    def row(self) -> dict:
        if self.rest:
            raise ValueError("text behind the last turn")
        return {
            "conv_id": self.conv, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "valid": self.valid,
        }


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation, from the formatted text and the loss flags alone: counts and digests of what they hold.

    Rows from storage are dealt and sorted by conversation and place; ``in_order`` skips that for rows that come
    straight from ``format_chat``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            done = []
            for conv, valid, segments in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv != reader.conv:
                    done += [reader.row()] if reader else []
                    reader = Reader(conv)
                reader.feed(segments, valid)
            yield pa.RecordBatch.from_pylist(done, _DIGEST)
        if reader:
            yield pa.RecordBatch.from_pylist([reader.row()], _DIGEST)

    rows = formatted if in_order else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.select("conv_id", "valid", "segments").mapInArrow(run, DIGEST)


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()),
])

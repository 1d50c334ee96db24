"""Chat formatting with a grammar round trip.

A turn is rendered as <|im_start|>role, newline, text, <|im_end|>, newline. The rendered turn is parsed again by a
deterministic parser; if role and text do not come back as they were, the turn is rendered once more with its
conflicting content escaped, and parsed again. Escaping puts a backslash after the < of every `<|`, `<\\|`, `<\\\\|` ...;
the parser takes one backslash away, so nothing is lost and no control string is left inside a role or text. In a role
the newline and the backslash are escaped too. Rendered turns concatenate to the conversation. A reader then goes through
the whole conversation's characters, which tell it alone where turns begin and end, and what it reads must equal the
source.

A conversation is one stream of one task, since its digests run from its first turn to its last: one conversation with a
third of all rows, or all rows without a conversation, take a third of the time of one task, in the memory of a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
OPEN, SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, start and end of the rendered text), or None if the input is not wholly made of turns or a role or text holds a mark."""
    out, at = [], 0
    while at < len(rendered):
        m = TURN.match(rendered, at)
        if not m or any(mark in part for mark in (START, END) for part in m.groups()):
            return None
        out.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def render(role: str, text: str) -> tuple[str, str, str, int, int]:
    """The rendered turn and what the parser reads back: role, text, start and end of the text in the rendered turn."""
    plain = f"{START}{role}\n{text}{END}\n"
    for rendered in (plain, f"{START}{escape_role(role)}\n{escape(text)}{END}\n"):
        turns = parse(rendered)
        if turns is not None and len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, *turns[0]
    raise ValueError("a turn does not survive the round trip")


def _by_turn(df: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, in order. Ties of turn come by role, then by text; null turns first."""
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(df: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, rendered, loss_start, loss_end (code points in the conversation; null if no loss).

    Partitions are read as streams, so a conversation of any length takes the memory of one batch. Null role or text
    counts as empty, null conv_id is a conversation of its own. An empty table gives no rows; other columns are left out.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, begun = None, 0, False
        for batch in batches:
            out = []
            for c, turn, role, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if not begun or c != conv:
                    conv, at, begun = c, 0, True
                rendered, role_, _, start, end = render(role, text)
                mask = (at + start, at + end) if role_ == "assistant" else (None, None)
                out.append((c, turn, rendered, *mask))
                at += len(rendered)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names=names) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=names)

    names, kinds = ["conv_id", "turn", "rendered", "loss_start", "loss_end"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return _by_turn(df).mapInArrow(stream, "conv_id long, turn long, rendered string, loss_start long, loss_end long")


class Reader:
    """Turns of a conversation that is fed piece by piece, wherever the pieces end."""

    def __init__(self) -> None:
        self.left = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, str]]:
        """role, text and the rendered text of each turn that is complete."""
        self.left += piece
        at = 0
        while m := TURN.match(self.left, at):
            if any(mark in part for mark in (START, END) for part in m.groups()):
                raise ValueError("a turn holds a control string")
            yield unescape_role(m[1]), unescape(m[2]), m[2]
            at = m.end()
        self.left = self.left[at:]

    def close(self) -> None:
        if self.left:
            raise ValueError("a conversation does not end with a turn")


class Digest:
    """What is read back from the formatted text of one conversation, compared with the source."""

    def __init__(self) -> None:
        self.reader, self.n, self.chars, self.size = Reader(), 0, 0, 0
        self.source, self.turns, self.loss = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        self.source.update(f"{role}\n{text}\n".encode())
        rendered = render(role, text)[0]
        self.size += len(rendered)
        for role_, text_, body in self.reader.feed(rendered):
            self.n += 1
            self.turns.update(f"{role_}\n{text_}\n".encode())
            if role_ == "assistant":
                loss = unescape(body)
                self.chars += len(loss)
                self.loss.update(loss.encode())

    def row(self) -> list:
        self.reader.close()
        if self.turns.digest() != self.source.digest():
            raise ValueError("a conversation does not survive the round trip")
        return [self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size]


def digests(df: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (all text
    under the loss mask, unescaped), formatted_chars. Same treatment of nulls, ties and empty tables as format_turns.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            done = []
            for c, _, role, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append([conv, *state.row()])
                    conv, state = c, Digest()
                state.add(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([conv, *state.row()], kinds, strict=True)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return _by_turn(df).mapInArrow(stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

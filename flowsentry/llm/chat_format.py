"""Chat formatting by a finite-state machine over roles.

A template is data: the states' allowed next roles, the text before and after
a turn, and the roles whose texts are trained on.  Conversations are read turn
by turn in order; the machine notes turns out of order, and each turn becomes
segments (marker, text, marker) with a loss flag each.  Concatenated, the
segments of a conversation are its formatted text.

Control strings inside texts are escaped: every backslash doubled and a
backslash put into every ``<|``, so no marker can start inside a text and
:func:`read_back` restores the exact text.

Turns are dealt by conversation and sorted, and the tasks stream over them, so
a conversation of any length needs the memory of one batch; only its rows are
in one task, since a turn's state depends on the turns before it.

Null role and null text are empty strings; turns of equal number are ordered
by role, then text; a null conversation id is a conversation of its own; a
role the template does not know is formatted and noted as out of order.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, prepare


@dataclass(frozen=True)
class ChatTemplate:
    """``next_roles`` maps a state to the roles that may follow (the state
    after a turn is its role; ``""`` is the start); ``ends`` are the states a
    whole conversation may stop in."""
    next_roles: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple = ("assistant",)
    turn_open: str = "<|turn|>"
    text_open: str = "<|text|>"
    turn_close: str = "<|end|>"
    loss_roles: tuple = ("assistant",)


DEFAULT_TEMPLATE = ChatTemplate()
SEGMENTS = "conv_id long, turn_no long, segment int, kind string, text string, loss boolean, in_order boolean"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def turn_segments(template: ChatTemplate, role: str, text: str):
    """(kind, text, loss) of one turn; the loss covers the text alone."""
    return (("open", template.turn_open + escape(role) + template.text_open, False),
            ("text", escape(text), role in template.loss_roles),
            ("close", template.turn_close, False))


def _batch(rows: list, names_types):
    columns = list(zip(*rows)) or [()] * len(names_types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names_types)],
                                      names=[n for n, _ in names_types])


_SEGMENT_TYPES = [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int32()), ("kind", pa.string()),
                  ("text", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_())]


def _format(template: ChatTemplate):
    def run(batches):
        conv, state, number = None, "", 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, state, number = c, "", 0
                ok = role in template.next_roles.get(state, ())
                for k, (kind, s, loss) in enumerate(turn_segments(template, role, text)):
                    out.append((c, number, k, kind, s, loss, ok))
                state, number = role, number + 1
            yield _batch(out, _SEGMENT_TYPES)
    return run


def format_conversations(turns: DataFrame, template: ChatTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """The segments of every conversation: conv_id, turn_no, segment (order
    within the turn), kind, text, loss, in_order (the machine allowed the
    turn)."""
    spark = prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.repartition(parallelism(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_format(template), SEGMENTS))


class _Reader:
    """Reads formatted text piece by piece: finds the turns by their markers
    alone, and the text under the loss flags."""

    def __init__(self, template: ChatTemplate):
        self.t = template
        self.turns = self.chars = self.loss_chars = 0
        self.sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.buffer: list[str] = []
        self.in_order = True
        self.last = ""

    def add(self, text: str, loss: bool, in_order: bool) -> None:
        self.chars += len(text)
        self.in_order &= in_order
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss_sha.update(plain.encode("utf-8", "surrogatepass"))
        self.buffer.append(text)
        if text.endswith(self.t.turn_close):
            self._turns()

    def _turns(self) -> None:
        whole = "".join(self.buffer)
        self.buffer = []
        *turns, rest = whole.split(self.t.turn_close)
        if rest:
            self.buffer = [rest]
        for turn in turns:
            role, text = turn[len(self.t.turn_open):].split(self.t.text_open, 1)
            self.last = unescape(role)
            self.turns += 1
            for part in (self.last, "\n", unescape(text), "\n"):
                self.sha.update(part.encode("utf-8", "surrogatepass"))

    def row(self, conv):
        valid = self.in_order and self.last in self.t.ends
        return (conv, self.turns, self.sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars, valid)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, valid boolean")


_DIGEST_TYPES = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                 ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]


def _read(template: ChatTemplate):
    def run(batches):
        conv, reader = None, None
        for batch in batches:
            out = []
            for c, text, loss, ok in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "loss", "in_order"))):
                if reader is None or c != conv:
                    if reader is not None:
                        out.append(reader.row(conv))
                    conv, reader = c, _Reader(template)
                reader.add(text, loss, ok)
            yield _batch(out, _DIGEST_TYPES)
        if reader is not None:
            yield _batch([reader.row(conv)], _DIGEST_TYPES)
    return run


def read_back(segments: DataFrame, template: ChatTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """Parse formatted conversations again: per conversation the number of
    turns, digests of the turns and of the text under the loss mask, the
    formatted length and whether the machine accepted it."""
    spark = prepare(segments.sparkSession)
    return (segments.repartition(parallelism(spark), "conv_id")
            .sortWithinPartitions("conv_id", "turn_no", "segment").mapInArrow(_read(template), DIGEST))

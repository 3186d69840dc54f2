"""Chat formatting: conversations rendered by a compiled template, with the stretches a model is to learn marked.

A conversation's rows are dealt by its id and sorted by turn, then streamed: neither the input nor the output of a
conversation is ever held whole, so one of any length takes the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.chat_template import compile_template
from listwright.llm.common import Buffer, column, in_arrow

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for message in messages %}{{ '<|im_start|>' + (message.role | role) + '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)
PIECE = 1 << 20  # characters after which a piece of output ends

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: one more backslash stands in each ``<|``, ``<\\|``, ``<\\\\|`` ..."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """On one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


FILTERS = {"escape": escape, "role": escape_role, "trim": str.strip}

_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("mask", pa.list_(pa.list_(pa.int64())))])
_PIECES_SQL = "conv_id long, piece long, text string, mask array<array<bigint>>"


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation's id and the stream of its messages, which must be used up before the next."""
    rows = (row for batch in batches for row in zip(column(batch, "conv_id"), column(batch, "role"), column(batch, "text")))
    after = next(rows, None)
    while after is not None:
        conv_id = after[0]

        def messages():
            nonlocal after
            while after is not None and after[0] == conv_id:
                yield {"role": after[1] or "", "text": after[2] or ""}
                after = next(rows, None)

        yield conv_id, messages()


def _render(template: str):
    def render(batches) -> Iterator[pa.RecordBatch]:
        run, out = compile_template(template, FILTERS), Buffer(_PIECES)
        for conv_id, messages in _conversations(batches):
            piece, parts, size, mask = 0, [], 0, []
            for text, masked in run(messages=messages):
                if masked:
                    mask.append([size, size + len(text)])
                parts.append(text)
                size += len(text)
                if size >= PIECE:
                    yield from out.add((conv_id, piece, "".join(parts), mask), 2 * size)
                    piece, parts, size, mask = piece + 1, [], 0, []
            for _ in messages:  # what a template does not read
                pass
            if parts or not piece:
                yield from out.add((conv_id, piece, "".join(parts), mask), 2 * size)
        yield from out.flush()

    return render


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, piece, text, mask): the pieces of each formatted conversation, in one partition, in order.

    ``mask`` has [start, end) in a piece's characters for each stretch to be learnt. Rows go by turn (null first), then role
    and text, so ties have one order; repeated rows are turns of their own; a null role or text is empty; rows without conv_id
    form one conversation. An empty table gives no rows.
    """
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_arrow(dealt.select("conv_id", "role", "text"), _render(template), _PIECES_SQL)


class _Reader:
    """Reads one conversation back from its pieces."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""

    def read(self, text: str, mask: list[list[int]]) -> None:
        for start, end in mask:
            learnt = unescape(text[start:end])
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
        self.chars += len(text)
        text, at = self.rest + text, 0
        while (end := text.find(END + "\n", at)) >= 0:
            if not text.startswith(START, at):
                raise ValueError("a turn does not begin with its mark")
            role, _, body = text[at + len(START) : end].partition("\n")
            self.turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
            self.n_turns += 1
            at = end + len(END) + 1
        self.rest = text[at:]

    def row(self, conv_id) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv_id} ends within a turn")
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(batches) -> Iterator[pa.RecordBatch]:
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    out, reader, current = Buffer(pa.schema([("conv_id", pa.int64()), *zip(names, kinds)])), None, None
    for batch in batches:
        for conv_id, piece, text, mask in zip(*(column(batch, name) for name in ("conv_id", "piece", "text", "mask"))):
            if piece == 0:
                if reader:
                    yield from out.add(reader.row(current))
                reader, current = _Reader(), conv_id
            reader.read(text, mask)
    if reader:
        yield from out.add(reader.row(current))
    yield from out.flush()


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learnt texts of conversations in the standard template, as hashes, from the formatted text alone.

    ``formatted`` is as ``format_conversations`` leaves it: a conversation's pieces together and in order.
    """
    return in_arrow(
        formatted,
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )

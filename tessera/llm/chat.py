"""Prefix-target expansion of conversations into training examples.

Every assistant turn is the target of its own example, whose context is all turns
before it; only the target's text is under the loss mask. ``expand`` makes one row an
example:

    conv_id, example_no, is_target, text, loss_start, loss_end, follows

``text`` is the context and the target, ``loss_start`` to ``loss_end`` the mask (code
points of ``text``, end exclusive). Turns after the last assistant turn come in one
more row of the whole conversation, with no target and no mask, so that nothing is
lost.

Written out, examples take the square of a conversation's length. Once a conversation is
over ``whole_chars`` code points, its rows therefore hold what follows the row before:
``follows`` is that row's number, and the example is that one's text (which may follow
another), then ``text``; offsets are those in ``text``. A run of turns over that length
with no target gets a row with no mask. Up to that length ``follows`` is null, and an
example stands for itself.

Template: ``### role: text</turn>`` and a line break. In roles and texts, backslash,
#, < and (in roles) : become a backslash and a letter, so no control string is found
in what a speaker said, and turning those pairs back restores it.

Conversations are streamed in order through tasks dealt by conv_id, holding at most
``whole_chars`` of a conversation and one turn at a time; examples depend on all turns
before them, so one conversation is one stream.

Defined cases: null texts and roles are empty; rows of equal conv_id and turn are
ordered by role, then text; a null conv_id is one conversation; null turns come
first; a turn over ``whole_chars`` is a row of its own length; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, COLON, END = "### ", ": ", "</turn>\n"
_PIECE = re.compile(r"### ([^:]*): ([^<]*)</turn>\n")
#: Code points up to which an example is written whole.
WHOLE_CHARS = 1 << 18
#: Code points of examples in a batch, about.
BATCH_CHARS = 1 << 21
#: Backslash first: it is part of the other pairs.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
_BACK = {pair: char for char, pair in ESCAPES}
_ESCAPED = re.compile(r"\\.", re.S)


def _escaped(column, chars: str):
    for char, pair in ESCAPES:
        if char in chars:
            column = F.replace(column, F.lit(char), F.lit(pair))
    return column


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each formatted turn."""
    out, at = [], 0
    while at < len(formatted):
        m = _PIECE.match(formatted, at)
        if not m:
            raise ValueError("not a formatted turn")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Rows:
    """Rows of a batch, column by column, of bounded size."""

    def __init__(self, schema: T.StructType, conv: pa.DataType) -> None:
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        self.names, self.kinds = schema.names, [conv, *(kinds[f.dataType.simpleString()] for f in schema.fields[1:])]
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.names)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.kinds, strict=True)], self.names)


def expand(
    conversations: DataFrame, target_role: str = "assistant", whole_chars: int = WHOLE_CHARS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The examples of all conversations; see the module for the columns."""
    said, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    body = _escaped(said, "\\#<")
    head = F.concat(F.lit(HEAD), _escaped(role, "\\#<:"), F.lit(COLON))
    pieces = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"), role.alias("_role"), said.alias("_said"),
        F.concat(head, body, F.lit(END)).alias("piece"), F.char_length(head).alias("_head"), F.char_length(body).alias("_body"),
    )
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "_role", "_said").select("conv_id", "_role", "piece", "_head", "_body")
    schema = T.StructType([ordered.schema["conv_id"]])
    for name, kind in (("example_no", "long"), ("is_target", "boolean"), ("text", "string"), ("loss_start", "long"), ("loss_end", "long"), ("follows", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, number, follows = None, object(), 0, None
        context: list[str] = []  # all turns so far, or those after the example that is followed
        chars, unwritten = 0, False  # of the context; whether turns are in no row yet

        def rest() -> None:
            if unwritten:
                rows.add((last, number, False, "".join(context), None, None, follows), chars)

        for batch in batches:
            rows = rows or _Rows(schema, batch.schema.field(0).type)
            for conv, spoke, piece, before, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    rest()
                    last, number, follows, context, chars = conv, 0, None, [], 0
                start = chars + before
                context.append(piece)
                chars += len(piece)
                target, long = spoke == target_role, chars > whole_chars
                unwritten = not target and not long
                if not unwritten:
                    rows.add((conv, number, target, "".join(context), start if target else None, start + size if target else None, follows), chars)
                    if follows is not None or long:
                        follows, context, chars = number, [], 0
                    number += 1
                if rows.size > BATCH_CHARS:
                    yield rows.taken()
        if rows:
            rest()
            yield rows.taken()

    return ordered.mapInArrow(run, schema)


def read_back(expanded: DataFrame) -> DataFrame:
    """Per conversation, from its examples and their loss masks alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. An example whose context is
    not all that came before it is an error."""
    ordered = expanded.select("conv_id", "example_no", "text", "loss_start", "loss_end", "follows").repartition("conv_id").sortWithinPartitions("conv_id", "example_no")
    schema = T.StructType([ordered.schema["conv_id"]])
    for name, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, turns = None, None, 0

        def closed() -> None:
            rows.add((last, turns, whole.hexdigest(), masked, loss.hexdigest(), chars), 1)

        for batch in batches:
            rows = rows or _Rows(schema, batch.schema.field(0).type)
            for conv, number, text, start, end, follows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not turns or conv != last:
                    if turns:
                        closed()
                    last, turns, masked, chars, before, expected, whole, loss = conv, 0, 0, 0, "", 0, hashlib.sha256(), hashlib.sha256()
                if number != expected or (follows is not None and follows != expected - 1) or (follows is None and not text.startswith(before)):
                    raise ValueError(f"example {number} of conversation {conv} does not hold all turns before it")
                new = text if follows is not None else text[len(before) :]
                said = parse(new)
                for role, words in said:
                    whole.update(f"{role}\n{words}\n".encode())
                turns, chars, expected, before = turns + len(said), chars + len(new), expected + 1, "" if follows is not None else text
                if start is not None:
                    target = unescape(text[start:end])
                    masked += len(target)
                    loss.update(target.encode())
            if len(rows.rows) > 10_000:
                yield rows.taken()
        if turns:
            closed()
        if rows:
            yield rows.taken()

    return ordered.mapInArrow(run, schema)

"""Chat formatting from event logs.

A log has one row per event: ``conv_id, turn, message, seq, kind, role, text``.  It is
partitioned by conversation and sorted, and folded as a stream:

* ``delta`` appends its text to the message;
* ``edit`` replaces the message's text; ``regenerate`` empties it, to be streamed anew.  Both
  undo what the log has before them (a smaller ``seq``) for later turns.

Turns come in order, so all a task keeps is the message in hand and the largest ``seq`` of an
edit or regeneration in the turns before: a conversation of any length needs the memory of its
longest message.  One task folds a conversation, since offsets and digests run through it.

Final messages are rendered one row each.  Marks delimit role and text, and the marks' strings
inside texts and roles are escaped by one more backslash after their first character, which is
undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
LEARNED_ROLE = "assistant"
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"
DELTA_CHARS = 256
EVENT_COLUMNS = ("conv_id", "turn", "message", "seq", "kind", "role", "text")

_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    head = f"{OPEN}{escape(role)}{MIDDLE}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def in_order(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text", name: str = "place") -> DataFrame:
    """The rows with a number ``name`` that grows, within a conversation, with turn (null last),
    role and text.  Null texts and roles are empty.

    Texts are sorted once per message, so that its events need only the number."""
    text, role = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
                  for c in (text_col, role_col))
    turn = F.col(f"`{turn_col}`").cast("long")
    return conversations.repartition(F.col(f"`{conv_col}`")).sortWithinPartitions(
        F.col(f"`{conv_col}`"), turn.asc_nulls_last(), role, text
    ).withColumn(name, F.monotonically_increasing_id())


def as_events(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text",
              delta_chars: int = DELTA_CHARS, order_col: str | None = None) -> DataFrame:
    """The log of finished conversations: each row is a message, streamed in deltas.

    Rows that share a turn are messages of their own, ordered by ``order_col``, which has no
    value twice in a conversation (see ``in_order``).  Without it they are ordered by role, the
    XXH64 of their text and then by an id that only tells equal rows apart.  Null texts and
    roles are empty.
    """
    row = F.col(f"`{order_col}`") if order_col else F.monotonically_increasing_id()
    text, role = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
                  for c in (text_col, role_col))
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), row.alias("row"))
    # cut in one pass; a part by its place would be sought from the start of the text
    pieces = F.when(F.length("text") == 0, F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0)))
    parts = rows.select("conv_id", "turn", "role", "row", F.xxhash64("text").alias("key"),
                        F.posexplode(pieces).alias("part", "text"))
    message = F.struct("row") if order_col else F.struct("role", "key", "row")
    # no turn is too large for a number of 38 digits
    turn = F.coalesce("turn", F.lit(0)).cast("decimal(20,0)")
    return parts.select(
        "conv_id", "turn", message.alias("message"),
        (turn * F.lit(1 << 24).cast("decimal(10,0)") + F.col("part")).cast("decimal(38,0)")
        .alias("seq"), F.lit(DELTA).alias("kind"), "role", "text")


PIECES = ("conv_id long, piece long, role string, formatted string, start long, loss_start long, "
          "loss_end long")


def fold(events: DataFrame) -> DataFrame:
    """Final turns of every conversation, rendered: one row per message that is left.

    ``start`` is where ``formatted`` begins in its conversation's whole text; ``loss_start`` and
    ``loss_end`` bound what is learned from it (an assistant's text; else both are null).

    Messages are ordered by turn (null last), then by ``message``, any sortable value.  Events
    of one message are ordered by ``seq``; of equal ones, by kind and text.  A message exists
    if one of its events is left; its role is that of the last of them.  Unknown kinds raise an
    error.  ``seq`` is an integer or a decimal.  A null id is a conversation of its own.  Null
    texts and roles are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        conv = turn = message = None
        piece = start = 0
        undone = pending = None  # largest seq of a reset in the turns before; and in this one
        parts: list[str] = []
        role, alive, begun = "", False, False

        def close() -> None:
            nonlocal piece, start, size
            if alive:
                formatted, a, b = render(role, "".join(parts))
                learned = role == LEARNED_ROLE
                out.append((conv, piece, role, formatted, start, start + a if learned else None,
                            start + b if learned else None))
                piece, start, size = piece + 1, start + len(formatted), size + len(formatted)

        for batch in batches:
            columns = (batch.column(c).to_pylist()
                       for c in ("conv_id", "turn", "message", "seq", "kind", "role", "text"))
            for c, t, m, seq, kind, r, text in zip(*columns):
                new_conv = not begun or c != conv
                if new_conv or t != turn or m != message:
                    close()
                    if size > 4_000_000 or len(out) > 20_000:
                        yield _piece_batch(out)
                        out, size = [], 0
                    if new_conv:
                        piece = start = 0
                        undone = pending = None
                    elif t != turn and pending is not None:
                        undone = pending if undone is None else max(undone, pending)
                        pending = None
                    conv, turn, message, begun = c, t, m, True
                    parts, role, alive = [], "", False
                if undone is not None and seq < undone:
                    continue
                if kind == DELTA:
                    parts.append(text or "")
                elif kind in (EDIT, REGENERATE):
                    parts = [text or ""] if kind == EDIT else []
                    pending = seq if pending is None else max(pending, seq)
                else:
                    raise ValueError(f"Unknown kind of event: {kind!r}")
                role, alive = r or "", True
        close()
        yield _piece_batch(out)

    wide = isinstance(events.schema["seq"].dataType, T.DecimalType)
    seq = F.col("seq") if wide else F.col("seq").cast("long")
    ordered = events.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("message").alias("order"),
        seq, "kind", "role", "text",
    ).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_last(), "order", "seq", "kind", "text")
    told_apart = F.to_json(F.struct("order")).alias("message")
    return ordered.select("conv_id", "turn", told_apart, "seq", "kind", "role", "text").mapInArrow(
        run, PIECES)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("role", pa.string()),
                        ("formatted", pa.string()), ("start", pa.int64()),
                        ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation from formatted pieces alone: turns parsed and unescaped, the
    text under the loss mask, lengths in code points.  Streams through each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, begun = None, False
        turns = chars = learned = 0
        turn_sum, loss_sum = hashlib.sha256(), hashlib.sha256()

        def rows():
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            columns = list(zip(*done)) or [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def close() -> None:
            if begun:
                done.append((conv, turns, turn_sum.hexdigest(), learned, loss_sum.hexdigest(),
                             chars))

        for batch in batches:
            columns = (batch.column(c).to_pylist()
                       for c in ("conv_id", "formatted", "start", "loss_start", "loss_end"))
            for c, formatted, start, a, b in zip(*columns):
                if not begun or c != conv:
                    close()
                    if len(done) > 10_000:
                        yield rows()
                        done = []
                    conv, begun = c, True
                    turns = chars = learned = 0
                    turn_sum, loss_sum = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(formatted):
                    turn_sum.update(f"{role}\n{text}\n".encode())
                    turns += 1
                chars += len(formatted)
                if a is not None:
                    text = unescape(formatted[a - start:b - start])
                    loss_sum.update(text.encode())
                    learned += len(text)
        close()
        yield rows()

    ordered = pieces.select("conv_id", "piece", "formatted", "start", "loss_start", "loss_end")
    return (ordered.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
            .mapInArrow(run, DIGESTS))

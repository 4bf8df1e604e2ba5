"""Chat formatting from an event log.

A log holds events of conversations: ``start`` opens a message in a role, ``delta`` appends streamed
text to it, ``edit`` replaces its text, ``regenerate`` discards it so that later deltas write it
anew, ``remove`` takes it out. Events are dealt out by message and sorted by sequence; folding them
gives the final messages. The messages of a conversation, sorted by their place, are then rendered:

    ### role
    text
    </turn>

Characters of control strings are escaped in roles and texts (``\\`` as ``\\\\``, ``#`` as ``\\h``, ``<``
as ``\\l``), so no text can look like a turn and the output can be read back. The loss mask covers the
escaped text of each assistant turn.

Both folds stream over rows that Spark has partitioned and sorted: a task holds one message, or one
turn and the running digests of its conversation, however long the conversation is.

Nulls and other cases: null text is empty, a null role is ``user`` if rendered and stays empty text
in digests; a null conversation is a conversation; null places come last; messages with equal places
are ordered by role and text; events repeated in full are applied again (an edit changes nothing, a
delta appends twice: a log numbers its events); a delta without a start opens a message with no
role; empty logs give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
HEAD, BREAK, TAIL = "### ", "\n", "\n</turn>\n"
LEARNED = "assistant"
TURN = re.compile(r"### ([^\n#<]*)\n([^#<]*)\n</turn>\n")
ESCAPED = re.compile(r"\\(.)", re.S)
BACK = {"\\": "\\", "h": "#", "l": "<", "n": "\n"}

MESSAGE = "conv_id long, place long, role string, text string"


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: BACK[m[1]], text)


def _stream(batches, names):
    for b in batches:
        yield from zip(*[b.column(n).to_pylist() for n in names])


def _arrow(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000):
    """Rows as Arrow batches; ``size`` bounds how many are held."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def messages(events: DataFrame) -> DataFrame:
    """Final messages of a log (conv_id, place, seq, kind, role, text), ``place`` naming the message."""

    def fold(rows):
        key, role, parts, there = None, None, [], False
        for conv, place, kind, who, text in rows:
            if key != (conv, place):
                if key is not None and there:
                    yield (*key, role, "".join(parts))
                key, role, parts, there = (conv, place), None, [], False
            text = text or ""
            if kind == "remove":
                role, parts, there = None, [], False
            elif kind == "start":
                role, parts, there = who, [text], True
            elif kind == "edit":
                parts, there = [text], True
            elif kind == "regenerate":
                parts, there = [], True
            elif kind == "delta":
                parts.append(text)
                there = True
            if who is not None:
                role = who
        if key is not None and there:
            yield (*key, role, "".join(parts))

    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    dealt = events.select("conv_id", "place", "seq", "kind", "role", "text").repartition("conv_id", "place").sortWithinPartitions("conv_id", "place", "seq", "kind", "role", "text")
    return dealt.mapInArrow(lambda batches: _arrow(fold(_stream(batches, ["conv_id", "place", "kind", "role", "text"])), schema), MESSAGE)


def _escaped(c: Column) -> Column:
    for plain, escaped in ESCAPES.items():  # the escape character first
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def rendered(of: DataFrame) -> DataFrame:
    """Turns (conv_id, place, role, text) with their ``piece`` of the output and its loss span.

    A conversation's output is its pieces in order of (place, role, text); ``loss_from`` and
    ``loss_until`` are offsets in the piece, equal where nothing is learned.
    """
    role = F.replace(_escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    text = _escaped(F.coalesce("text", F.lit("")))
    start = F.length(F.lit(HEAD)) + F.length(role) + 1
    end = F.when(F.col("role") == LEARNED, start + F.length(text)).otherwise(start)
    return of.select(
        "conv_id",
        "place",
        "role",
        "text",
        F.concat(F.lit(HEAD), role, F.lit(BREAK), text, F.lit(TAIL)).alias("piece"),
        start.cast("long").alias("loss_from"),
        end.cast("long").alias("loss_until"),
    )


def in_sequence(pieces: DataFrame) -> DataFrame:
    """Pieces dealt out by conversation and sorted as they are to be written."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_last(), "role", "text")


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, from the output alone: turns, their digest, loss text and sizes."""

    def fold(rows):
        conv, state = None, None
        for c, piece, a, b in rows:
            if state is None or c != conv:
                if state is not None:
                    yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            end = 0
            for m in TURN.finditer(piece):
                if m.start() != end:
                    break
                end = m.end()
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            if end != len(piece):
                raise ValueError(f"output of conversation {c} can't be read back")
            learned = unescape(piece[a:b])
            state[2] += len(learned)
            state[3].update(learned.encode("utf-8", "surrogatepass"))
            state[4] += len(piece)
        if state is not None:
            yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    names = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    schema = pa.schema(list(names.items()))
    return in_sequence(pieces).mapInArrow(
        lambda batches: _arrow(fold(_stream(batches, ["conv_id", "piece", "loss_from", "loss_until"])), schema),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """A finished table of turns as a log: each turn is started, then its text arrives as one delta.

    Rows that share a turn are messages of their own: the place is the turn, and rows are told apart
    by position among equals.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    placed = conversations.select("conv_id", "turn", "role", "text").withColumn("place", F.coalesce("turn", F.lit(1 << 32)) * (1 << 30) + nth)
    kinds = F.explode(
        F.array(
            F.struct(F.lit(0).alias("seq"), F.lit("start").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")),
            F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text")),
        )
    )
    return placed.select("conv_id", "place", kinds.alias("e")).select("conv_id", "place", "e.seq", "e.kind", "e.role", "e.text")

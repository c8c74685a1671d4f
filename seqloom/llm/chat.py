"""Chat formatting with spans found by rendering, whatever the template does inside.

A template is a black box: a function from a list of (role, text) to a string. The turns of a conversation are rendered prefix by
prefix. Where a prefix's output begins with the output before it, the rest is the new turn's span; where it doesn't, the
template rewrites history, which is reported with the turn at which it first did. Two probes of one letter in
place of the text show where the text stands inside its span, which gives the loss mask of assistant turns.

Conversations stream through a task turn by turn in sorted order. Prefixes are whole, unless a template states how many turns it looks
back (``look_back``, 0 if a turn's output needs no other turn): then they restart every ``CHUNK`` turns from the turns that it can
see, so memory and work per turn stay bounded however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import parallelism, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
CHUNK = 32
END = "</turn>"
MARK = "###"
#: Escapes of what has a meaning in the output; a backslash starts each.
_ESCAPES = {"\\": "\\\\", MARK: "\\h\\h\\h", END: "\\l/turn>"}
_ESCAPE = re.compile("|".join(map(re.escape, _ESCAPES)))
_UNESCAPES = {"\\\\": "\\", "\\h": "#", "\\l": "<", "\\c": ":"}
_UNESCAPE = re.compile(r"\\[\\hlc]")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _UNESCAPES[m[0]], text)


def marked_turns(turns: list[Turn]) -> str:
    """Our template: a marked header with the role, the escaped text, an end mark."""
    return "".join(f"{MARK} {escape(role).replace(':', '\\c')}: {escape(text)}{END}\n" for role, text in turns)


marked_turns.look_back = 0


def read_back(output: str) -> list[Turn]:
    """The turns of an output of ``marked_turns``."""
    turns = []
    for piece in output.split(f"{END}\n")[:-1]:
        role, _, text = piece.removeprefix(f"{MARK} ").partition(": ")
        turns.append((unescape(role), unescape(text)))
    return turns


@dataclass
class Piece:
    """What one turn adds: its role, output, and where its text stands inside (None if the template changes the text's surroundings)."""

    role: str
    output: str
    body: tuple[int, int] | None
    rewrote: bool


def render_incrementally(turns: Iterable[Turn], template: Template = marked_turns, chunk: int = CHUNK) -> Iterator[Piece]:
    """A piece for each turn; the outputs joined are the rendering, unless a piece says that history was rewritten.

    ``chunk`` only bounds the prefixes of a template with a ``look_back``, which neither reads nor rewrites turns before those."""
    look_back = getattr(template, "look_back", None)
    prefix: list[Turn] = []
    before = ""
    for role, text in turns:
        if look_back is not None and len(prefix) > max(chunk, look_back):
            prefix = prefix[-max(look_back, 1) :]
            before = template(prefix)
        now = template([*prefix, (role, text)])
        a, b = template([*prefix, (role, "a")]), template([*prefix, (role, "b")])
        rewrote = not now.startswith(before)
        piece = now[len(before) :] if not rewrote else now
        body = None
        at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), -1)
        if not rewrote and at >= len(before) and len(a) == len(b) and a[at + 1 :] == b[at + 1 :]:
            head, tail = a[len(before) : at], a[at + 1 :]
            if piece.startswith(head) and piece.endswith(tail) and len(piece) >= len(head) + len(tail):
                body = len(head), len(piece) - len(tail)
        yield Piece(role, piece, body, rewrote)
        prefix.append((role, text))
        before = now


def _turns_by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """Conversations of sorted rows, one after another; each must be read to its end before the next."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    for conv_id, group in groupby(rows, key=lambda r: r[0]):
        yield conv_id, ((role or "", text or "") for _, role, text in group)


def _sorted(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    return conversations.select("conv_id", "turn", "role", "text").repartition(parallelism(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: Template = marked_turns, loss_role: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """A row per turn: conv_id, place (from 0), role, output, loss_start, loss_end (within output, null if none), rewrote.

    Turns come by turn, role, text; null roles and texts are empty; repeated rows are turns of their own; a null conv_id is one
    conversation; an empty table gives no rows.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("output", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("rewrote", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for conv_id, turns in _turns_by_conversation(batches):
            for place, p in enumerate(render_incrementally(turns, template, chunk)):
                start, end = p.body if p.body and p.role == loss_role else (None, None)
                rows.append({"conv_id": conv_id, "place": place, "role": p.role, "output": p.output, "loss_start": start, "loss_end": end, "rewrote": p.rewrote})
                size += len(p.output)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return _sorted(conversations).mapInArrow(run, "conv_id long, place long, role string, output string, loss_start long, loss_end long, rewrote boolean")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])
    rows: list[dict] = []
    for conv_id, turns in _turns_by_conversation(batches):
        all_turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        rewrites = False
        for p in render_incrementally(turns):
            rewrites |= p.rewrote
            chars += len(p.output)
            for role, text in read_back(p.output):
                n += 1
                all_turns.update(f"{role}\n{text}\n".encode())
            if p.role == "assistant" and p.body:
                text = unescape(p.output[slice(*p.body)])
                loss_chars += len(text)
                loss.update(text.encode())
        rows.append({"conv_id": conv_id, "n_turns": n, "turns_sha256": all_turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "rewrites": rewrites})
        if len(rows) >= 5000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7, formatted, read back and digested.

    Null roles and texts are empty; rows without a conv_id are one conversation; repeated rows and equal turns are turns of their own, in the order of role and text; an empty
    table gives the probe alone; other columns are not read. A conversation is rendered in one task, as each turn needs those before it: its turns pass one by one,
    and the task holds their texts.
    """
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return _sorted(rows.unionByName(extra)).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")

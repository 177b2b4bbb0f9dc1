"""Chat formatting by columnar byte assembly, with a loss mask, and the way back.

Template: <s> begins a conversation; a turn is one of

    [INST] user's text [/INST]      [ANS] assistant's text </s>      [SYS] system's text [/SYS]
    [ROLE] any other role [/ROLE] its text [/TURN]

with the spaces shown and nothing between turns. A control string inside a text or a role's name gets a backslash after its first
character, one that has backslashes there gets one more; taking one away gives the text back, whatever it was. The mask covers the
assistant's (escaped) texts, as byte ranges in UTF-8.

Spark deals out the rows by conversation and sorts them, spilling where it must. A task takes them in slices: the lengths of all
segments (marks, names, texts) are computed as arrays, their cumulative sums are the places in the result, and one gather through
an index array copies marks and texts into one preallocated Arrow buffer. No string is joined in Python. A conversation longer
than SLICE_BYTES comes as several parts next to one another, cut between turns, so that none is held whole.

Cases: null texts and roles read as empty; an empty role is written as a name. Turns go by turn, nulls first, then by role and
text; repeated rows stay. A null conv_id is a conversation of its own. Other columns are ignored, whatever their names. An empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices

BEGIN = "<s>"
ROLES = ("user", "assistant", "system")
OPEN = ("[INST] ", "[ANS] ", "[SYS] ", "[ROLE] ")
NAMED = " [/ROLE] "
CLOSE = (" [/INST]", " </s>", " [/SYS]", " [/TURN]")
CONTROL = r"(/?s>|/?(?:INST|ANS|SYS|ROLE|TURN)\])"
ESCAPE, PLAIN = r"([<\[])(\\*)" + CONTROL, r"\1\\\2\3"
UNESCAPE = re.compile(r"([<\[])\\(\\*)" + CONTROL)
TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|\[ANS\] (.*?) </s>|\[SYS\] (.*?) \[/SYS\]|\[ROLE\] (.*?) \[/ROLE\] (.*?) \[/TURN\]", re.DOTALL)
SCHEMA = "conv_id long, part int, n_turns long, text string, loss_start array<int>, loss_end array<int>"
NAMES = ["conv_id", "part", "n_turns", "text", "loss_start", "loss_end"]
#: Marks one after another, and where each begins and how long it is: BEGIN, OPEN, NAMED, CLOSE.
MARKS = [m.encode() for m in (BEGIN, *OPEN, NAMED, *CLOSE)]
POOL = np.frombuffer(b"".join(MARKS), np.uint8)
MARK_SIZE = np.array([len(m) for m in MARKS], np.int64)
MARK_AT = np.concatenate([[0], np.cumsum(MARK_SIZE)[:-1]])


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a string array without nulls, and the offsets of its values."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def assemble(role: pa.Array, text: pa.Array, begins: np.ndarray) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer, the place of each turn in it (and the end), and that of each turn's text (n x 2). begins:
    the turns that begin a conversation."""
    kind = pc.fill_null(pc.index_in(role, pa.array(ROLES)), len(ROLES)).to_numpy(zero_copy_only=False).astype(np.int64)
    escaped = lambda c: pc.replace_substring_regex(pc.fill_null(c, ""), ESCAPE, PLAIN)
    (names, name_at), (texts, text_at) = _bytes_of(escaped(role)), _bytes_of(escaped(text))
    source = np.concatenate([POOL, names, texts])
    other, n = kind == len(ROLES), len(kind)
    size, start = np.empty((n, 6), np.int64), np.empty((n, 6), np.int64)

    def mark(column: int, number, where=None) -> None:
        size[:, column] = MARK_SIZE[number] if where is None else np.where(where, MARK_SIZE[number], 0)
        start[:, column] = MARK_AT[number]

    mark(0, np.zeros(n, np.int64), begins)
    mark(1, 1 + kind)
    size[:, 2], start[:, 2] = np.where(other, np.diff(name_at), 0), len(POOL) + name_at[:-1]
    mark(3, np.full(n, 1 + len(OPEN)), other)
    size[:, 4], start[:, 4] = np.diff(text_at), len(POOL) + len(names) + text_at[:-1]
    mark(5, 2 + len(OPEN) + kind)
    flat = size.ravel()
    at = np.concatenate([[0], np.cumsum(flat)])
    out = pa.allocate_buffer(int(at[-1]))
    index = np.arange(at[-1]) + np.repeat(start.ravel() - at[:-1], flat)
    np.take(source, index, out=np.frombuffer(out, np.uint8), mode="clip")
    place = at[:-1].reshape(n, 6)
    return out, np.append(place[:, 0], at[-1]), np.stack([place[:, 4], place[:, 4] + size[:, 4]], 1)


def _new(conv: pa.Array) -> np.ndarray:
    """Whether a turn's conversation is another one than that of the turn before."""
    ids, null = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return new


def _format(turns: pa.RecordBatch, first_part: int) -> pa.RecordBatch:
    """Conversations of sorted turns; the first of them goes on at a part, 0 if it begins here."""
    conv, new = turns.column("conv_id"), _new(turns.column("conv_id"))
    begins = new.copy()
    begins[0] = first_part == 0
    out, place, said = assemble(turns.column("role"), turns.column("text"), begins)
    rows = np.flatnonzero(new)
    bounds = np.append(rows, len(turns))
    offsets = place[bounds]
    text = pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets.astype(np.int32)), out)
    loss = np.flatnonzero(pc.fill_null(pc.equal(turns.column("role"), "assistant"), False).to_numpy(zero_copy_only=False))
    here = np.searchsorted(loss, bounds).astype(np.int32)
    shift = offsets[np.searchsorted(rows, loss, "right") - 1]
    spans = [pa.ListArray.from_arrays(pa.array(here), pa.array((said[loss, k] - shift).astype(np.int32))) for k in (0, 1)]
    part = np.zeros(len(rows), np.int32)
    part[0] = first_part
    return pa.RecordBatch.from_arrays([conv.take(pa.array(rows)), pa.array(part), pa.array(np.diff(bounds)), text, *spans], NAMES)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, text (formatted), and the byte ranges under the loss mask, from conv_id, turn, role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # turns of one conversation, which may go on in the next batch
        part, before = 0, None
        for batch in batches:
            for piece in slices(batch, "text"):
                same = before is not None and before[0] == piece.column("conv_id")[0].as_py()
                turns = piece
                if held is not None and same:
                    turns = pa.Table.from_batches([held, piece]).combine_chunks().to_batches()[0]
                elif held is not None:
                    yield _format(held, part)
                part = part if same else 0
                last = int(np.flatnonzero(_new(turns.column("conv_id")))[-1])
                if last:
                    yield _format(turns.slice(0, last), part)
                    part = 0
                held = turns.slice(last)
                before = (held.column("conv_id")[0].as_py(),)
                if (pc.sum(pc.binary_length(held.column("text"))).as_py() or 0) > SLICE_BYTES or len(held) > 1 << 16:
                    yield _format(held, part)
                    held, part = None, part + 1
        if held is not None:
            yield _format(held, part)

    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    out = []
    for m in TURN.finditer(text):
        k = m.lastindex
        out.append((ROLES[k - 1], unescape(m[k])) if k <= len(ROLES) else (unescape(m[4]), unescape(m[5])))
    return out


def masked(text: bytes, starts: list[int], ends: list[int]) -> list[str]:
    """The texts under the loss mask."""
    return [unescape(text[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(starts, ends, strict=True)]


def digest(formatted: DataFrame) -> DataFrame:
    """One row for each conversation of `format_chats`, read back from its formatted text and its mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> tuple:
            return conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars

        started = False
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["part"] == 0:
                    if started:
                        done.append(row())
                    started, conv, n, n_loss, chars, turns, loss = True, r["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(r["text"]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for text in masked(r["text"].encode("utf-8", "surrogatepass"), r["loss_start"], r["loss_end"]):
                    n_loss += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(r["text"])
            yield _rows(done)
        if started:
            yield _rows([row()])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        types = [pa.string() if name.endswith("sha256") else pa.int64() for name in names]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

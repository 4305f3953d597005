"""Chat formatting: conversations as one marked text each, assembled by columns.

A batch of turns is laid out with numpy: lengths of headers and contents give
offsets by running sums, offsets give scatter indices, and all bytes go into one
preallocated buffer that becomes an Arrow string column without another copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w

TURNS_PER_PART = 64
ROWS_HELD = 10_000
ESCAPE = "\x10"

# Marks of common chat templates, the own ones first.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "[INST]", "[/INST]",
            "<<SYS>>", "<</SYS>>", "<s>", "</s>")


@dataclass(frozen=True)
class Template:
    """A turn is open, role, after_role, content, close.

    In roles and contents the escape character becomes itself and "0", and the
    i-th control string the escape character and chr(ord("A") + i); in roles the
    newline that ends them becomes the escape character and "1".  Each step can be
    taken back, and what comes out holds no control string.
    """

    open: str = CONTROLS[0]
    after_role: str = "\n"
    close: str = CONTROLS[1] + "\n"
    controls: tuple[str, ...] = CONTROLS

    def code(self, i: int) -> str:
        return ESCAPE + chr(ord("A") + i)

    def escaped(self, texts: pa.Array) -> pa.Array:
        out = pc.replace_substring(texts, ESCAPE, ESCAPE + "0")
        for i, control in enumerate(self.controls):
            out = pc.replace_substring(out, control, self.code(i))
        return out

    def unescaped(self, text: str) -> str:
        def original(m: re.Match) -> str:
            return {"0": ESCAPE, "1": "\n"}.get(m[1]) or self.controls[ord(m[1]) - ord("A")]

        return re.sub(ESCAPE + "(.)", original, text)

    def turns(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Role, and first and last character of the content, of each turn of a formatted text."""
        at = 0
        while at < len(text):
            role_end = text.index(self.after_role, at)
            begin = role_end + len(self.after_role)
            end = text.index(self.close, begin)
            yield self.unescaped(text[at + len(self.open) : role_end]), begin, end
            at = end + len(self.close)


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + lengths[i] - 1 for all i, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def assemble(template: Template, roles: pa.Array, contents: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted texts of the conversations that start at the turns ``first``.

    Also the byte offset of every turn's content in its text, and its length.
    """
    pieces = [template.open, pc.replace_substring(template.escaped(roles), "\n", ESCAPE + "1"), template.after_role, template.escaped(contents), template.close]
    n = len(roles)
    columns, lengths = [], []
    for piece in pieces:
        if isinstance(piece, str):
            raw = np.frombuffer(piece.encode(), np.uint8)
            columns.append((raw, None))
            lengths.append(np.full(n, len(raw), np.int64))
        else:
            raw, offsets = w.text_bytes(piece)
            columns.append((raw, offsets))
            lengths.append(np.diff(offsets))
    sizes = np.stack(lengths)
    turn_ends = np.cumsum(sizes.sum(axis=0))
    turn_starts = turn_ends - sizes.sum(axis=0)
    begin = turn_starts + np.cumsum(sizes, axis=0) - sizes
    total = int(turn_ends[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for (raw, offsets), at, length in zip(columns, begin, sizes):
        if offsets is None:
            out[at[:, None] + np.arange(len(raw))] = raw
        else:
            out[_places(at, length)] = raw
    bounds = np.append(turn_starts[first], total).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), buffer)
    of_turn = np.repeat(turn_starts[first], np.diff(np.append(first, n)))
    return texts, begin[3] - of_turn, sizes[3]


FORMATTED = "conv_id long, part long, piece int, n_turns int, text string, loss array<struct<start:long,length:long>>"


def _formatter(template: Template, learned: str):
    """Format whole parts; one that outgrows ROWS_HELD goes out in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        piece = 0  # of the part that held begins with
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            ends = np.flatnonzero(_changes(held))
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                yield _format(template, learned, held.slice(0, whole), piece)
                held, piece = held.slice(whole), 0
            if held.num_rows > ROWS_HELD:  # the last row stays, as the next may or may not end its part
                yield _format(template, learned, held.slice(0, held.num_rows - 1), piece)
                held, piece = held.slice(held.num_rows - 1), piece + 1
        if held is not None and held.num_rows:
            yield _format(template, learned, held, piece)

    return run


def _ids(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table[name].combine_chunks()
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _changes(table: pa.Table) -> np.ndarray:
    """Whether each row but the last ends its part."""
    out = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in ("conv_id", "part"):
        for values in _ids(table, name):
            out |= values[1:] != values[:-1]
    return out


def _format(template: Template, learned: str, table: pa.Table, piece: int) -> pa.RecordBatch:
    first = np.append(0, np.flatnonzero(_changes(table)) + 1)
    roles, contents = table["role"].combine_chunks(), table["text"].combine_chunks()
    texts, at, length = assemble(template, roles, contents, first)
    # Byte offsets to characters: count the bytes that start one, up to each offset.
    raw, offsets = w.text_bytes(texts)
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    base = np.repeat(offsets[:-1], np.diff(np.append(first, len(roles))))
    start = chars[base + at] - chars[base]
    size = chars[base + at + length] - chars[base + at]
    marked = np.flatnonzero(pc.equal(roles, learned).to_numpy(zero_copy_only=False))
    bounds = np.searchsorted(marked, np.append(first, len(roles))).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start[marked]), pa.array(size[marked])], ["start", "length"])
    columns = [table["conv_id"].combine_chunks().take(pa.array(first)), table["part"].combine_chunks().take(pa.array(first)),
               pa.array([piece] + [0] * (len(first) - 1), pa.int32()), pa.array(np.diff(np.append(first, len(roles))), pa.int32()), texts.cast(pa.string()),
               pa.ListArray.from_arrays(pa.array(bounds), spans)]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "piece", "n_turns", "text", "loss"])


def format_conversations(turns: DataFrame, template: Template = Template(), learned: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, part, piece, n_turns, text, loss).

    A conversation's text is its parts' texts in order of part and piece.  A part
    holds 64 turn numbers, so the parts of a hot conversation are dealt out, and a
    part of very many rows (equal or null numbers) goes out in pieces, so a task
    holds a bounded number of rows.  ``loss`` marks, in characters of the part, the contents of
    turns whose role is ``learned``.  Turns are ordered by number, null last,
    then role and text; null roles and texts are empty; a null conv_id is a
    conversation of its own; repeated rows are turns of their own.  Further
    columns are left out.
    """
    part = F.coalesce(F.floor(F.col("turn") / TURNS_PER_PART), F.lit(2**62)).cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), part.alias("part"), F.col("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_last(), "role", "text")
    return dealt.mapInArrow(_formatter(template, learned), FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Read formatted conversations back: counts and digests of what they hold.

    Parts stream through in order and only running digests are kept, so a
    conversation of any length needs constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, state = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    if state is not None:
                        done.append(finished(now, state))
                    now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["text"]
                for role, begin, end in template.turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{template.unescaped(text[begin:end])}\n".encode())
                for span in row["loss"]:
                    content = template.unescaped(text[span["start"] : span["start"] + span["length"]])
                    state[2] += len(content)
                    state[3].update(content.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([finished(now, state)], schema)

    def finished(conv, state):
        return {"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    in_order = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return in_order.mapInArrow(run, DIGESTS)

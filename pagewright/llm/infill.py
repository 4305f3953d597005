"""Fill in the middle: documents rearranged so that a model learns to complete a gap.

Where a document is cut is drawn in tokens (a word with the white space before
it, or the white space at the end), so tokens have to be counted and the cuts
found in the bytes.  A rolling hash of the last 32 bytes cuts texts into chunks
at places that depend on the content alone; passages that documents share give
equal chunks, however they are shifted.  What a chunk adds to a document's
count, and how it joins its neighbours, is a summary of a few numbers, kept in a
cache by the chunk's bytes.  Running sums over the summaries give every
document's count and the chunk that holds a cut, and only that one is scanned.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words as w

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW = 32  # bytes that the rolling hash covers, one per bit of it
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class Chunking:
    """Chunks have ``least`` to ``most`` bytes; past ``least`` one byte of 2 ** ``bits`` ends one."""

    least: int = 256
    most: int = 16384
    bits: int = 10

    def ends(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of texts end in their bytes, and each text's first chunk (one entry more than texts)."""
        marks = (np.flatnonzero(rolling(raw) >> np.uint32(32 - self.bits) == 0) + 1).tolist()
        ends, first, at = [], [0], 0
        bounds = offsets.tolist()
        for low, end in zip(bounds, bounds[1:]):
            while low < end:
                at = bisect_left(marks, low + self.least, at)
                low = min(marks[at] if at < len(marks) else end, low + self.most, end)
                ends.append(low)
            first.append(len(ends))
        return np.array(ends, np.int64), np.array(first, np.int64)


def rolling(raw: np.ndarray) -> np.ndarray:
    """A hash of the up to WINDOW bytes that end at each byte: the sum of GEAR[byte] << distance, modulo 2**32."""
    out = GEAR[raw]
    step = 1
    while step < min(WINDOW, len(raw)):
        # The sum over 2 * step bytes is that over step bytes and the shifted one before it.
        out[step:] += out[:-step] << np.uint32(step)
        step *= 2
    return out


@dataclass
class Summaries:
    """What chunks add to a text, by content: a dictionary compares the bytes, so a hit is no guess.

    A summary is token ends inside the chunk, characters, and whether its first
    byte is white space and its last is not.  When the chunks held pass ``room``
    bytes the cache starts anew; it then only has to count again.
    """

    room: int = 64 << 20
    known: dict = field(default_factory=dict)
    held: int = 0
    hits: int = 0

    def of(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One row per chunk."""
        blob = raw.tobytes()
        bounds = [0, *ends.tolist()]
        chunks = [blob[a:b] for a, b in zip(bounds, bounds[1:])]
        new = [x for x in dict.fromkeys(chunks) if x not in self.known]
        self.hits += len(chunks) - len(new)
        counted = dict(zip(new, _summarise(new)))
        out = np.array([counted.get(x) or self.known[x] for x in chunks], np.int64).reshape(len(chunks), 4)
        size = sum(map(len, new))
        if self.held + size > self.room:
            self.known, self.held = {}, 0
        self.known |= counted
        self.held += size
        return out


def _token_ends(raw: np.ndarray) -> np.ndarray:
    """The places before white space that follows a word; the end of the bytes is none."""
    space = w._SPACE_BYTES[raw]
    return np.flatnonzero(~space[:-1] & space[1:]) + 1


def _summarise(chunks: list[bytes]) -> list[tuple[int, int, int, int]]:
    if not chunks:
        return []
    raw = np.frombuffer(b"".join(chunks), np.uint8)
    last = np.cumsum([len(x) for x in chunks])
    begin = last - [len(x) for x in chunks]
    space = w._SPACE_BYTES[raw]
    ends = np.zeros(len(raw), np.int64)
    ends[1:] = ~space[:-1] & space[1:]
    ends[begin] = 0
    chars = np.add.reduceat(((raw & 0xC0) != 0x80).astype(np.int64), begin)
    return list(zip(np.add.reduceat(ends, begin).tolist(), chars.tolist(), space[begin].astype(int).tolist(), (~space[last - 1]).astype(int).tolist()))


class Located:
    """Token counts of texts and the places of their tokens, from the summaries of their chunks."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, chunking: Chunking, cache: Summaries):
        self.raw, self.offsets = raw, offsets
        self.ends, self.first = chunking.ends(raw, offsets)
        self.begins = np.append(0, self.ends)
        inside, chars, opens, closes = cache.of(raw, self.ends).T
        # A word that ends with a chunk ends a token if the text goes on with white space.
        joint = np.zeros(len(self.ends), np.int64)
        joint[1:] = closes[:-1] & opens[1:]
        joint[self.first[:-1][np.diff(self.first) > 0]] = 0
        self.joint = joint
        self.tokens = np.append(0, np.cumsum(inside + joint))
        self.chars = np.append(0, np.cumsum(chars))
        # The end of a text ends its last token.
        self.counts = self.tokens[self.first[1:]] - self.tokens[self.first[:-1]] + (np.diff(offsets) > 0)

    def cut(self, text: int, tokens: int) -> tuple[int, int]:
        """Byte (in all bytes) and character (in the text) after so many tokens of a text."""
        low, high = self.first[text], self.first[text + 1]
        if tokens == 0:
            return int(self.offsets[text]), 0
        if tokens == self.counts[text]:
            return int(self.offsets[text + 1]), int(self.chars[high] - self.chars[low])
        wanted = self.tokens[low] + tokens
        chunk = int(np.searchsorted(self.tokens[low + 1 : high + 1], wanted)) + low
        begin, nth = int(self.begins[chunk]), int(wanted - self.tokens[chunk] - self.joint[chunk])
        at = begin
        if nth:
            at += int(_token_ends(self.raw[begin : self.begins[chunk + 1]])[nth - 1])
        chars = self.chars[chunk] - self.chars[low] + np.count_nonzero((self.raw[begin:at] & 0xC0) != 0x80)
        return at, int(chars)


ADDED = "text string, n long, form string, prefix_chars long, middle_chars long"


def infill(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80, chunking: Chunking = Chunking()) -> DataFrame:
    """``docs`` with the text rearranged, and n, form, prefix_chars and middle_chars.

    n is the number of tokens; what ``doc_id`` and the seed draw says whether a
    text is rearranged (``percent`` of them), where it is cut, and whether the
    suffix comes first (form spm, ``suffix_first`` per cent of these) or the prefix
    (psm).  Empty texts and those that hold a mark stay as they are (plain), and
    their numbers of characters are null.  A null text is an empty one; a null
    doc_id draws as an empty one; rows with one doc_id draw alike, each for its
    own text.  Columns named like the added ones are replaced, all others pass
    through.  There is no shuffle; a task holds a slice of a few megabytes or one
    text, and its cache.
    """
    held = w.record(docs, _key=F.coalesce(F.col("doc_id").cast("string"), F.lit("")), _text=F.col("text"))
    held = held.drop(f"_r{docs.columns.index('text')}")
    kept = w.recorded(held)
    schema = StructType([held.schema[c] for c in kept] + StructType.fromDDL(ADDED).fields)
    names = schema.names
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def formed(at: Located, blob: bytes, i: int, key: str) -> tuple:
        begin, end = int(at.offsets[i]), int(at.offsets[i + 1])
        text, n = blob[begin:end], int(at.counts[i])
        digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
        one, two, three, four = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
        if three % 100 >= percent or not text or any(x in text for x in marks):
            return text, n, "plain", None, None
        low, high = sorted((one % (n + 1), two % (n + 1)))
        (a, before), (b, until) = at.cut(i, low), at.cut(i, high)
        prefix, middle, suffix = blob[begin:a], blob[a:b], blob[b:end]
        if four % 100 < suffix_first:
            return b"".join((s, suffix, p, prefix, m, middle)), n, "spm", before, until - before
        return b"".join((p, prefix, s, suffix, m, middle)), n, "psm", before, until - before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Summaries()
        for batch in batches:
            keys = batch.column("_key")
            for low, high, raw, offsets in w.slices(batch.column("_text")):
                at, blob = Located(raw, offsets, chunking, cache), raw.tobytes()
                rows = [formed(at, blob, i, key) for i, key in enumerate(keys.slice(low, high - low).to_pylist())]
                text, *rest = zip(*rows)
                added = [pa.array(text, pa.binary()).view(pa.string()), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.string(), pa.int64(), pa.int64())))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in kept), *added], names=names)

    return w.unrecord(held.mapInArrow(run, schema), docs.columns, "text", "n", "form", "prefix_chars", "middle_chars")


def restored(text: Column, form: Column) -> Column:
    """The text that a rearranged one was made from; each mark stands in it once."""

    def between(first: str, last: str | None) -> Column:
        rest = F.substring_index(text, first, -1)
        return F.substring_index(rest, last, 1) if last else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)

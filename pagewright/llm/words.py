"""Words of texts: Column expressions for the JVM, numpy for Arrow batches."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words, and the characters that end a benchmark word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
TERM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def space_words(text: Column) -> Column:
    """The maximal runs of ``[^\\x20\\x09-\\x0D]``; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS + "+")).otherwise(_no_words())


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, all other characters as they are.

    ``lower`` does just that on texts of ASCII alone and is faster there.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_words(text: Column) -> Column:
    """The maximal runs of letters a-z, digits and non-ASCII, lower-cased; null has none."""
    words = F.split(ascii_lower(text), TERM_BREAK)
    inner = F.array_remove(words, "")
    return F.coalesce(inner, _no_words())


def _no_words() -> Column:
    return F.array().cast("array<string>")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, inside one expression."""
    return F.transform(F.array(value), use)[0]


def record(docs: DataFrame, **named: Column) -> DataFrame:
    """All columns of ``docs`` renamed by number, beside named ones, so that no name can clash."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(docs.columns)], *[c.alias(n) for n, c in named.items()])


def recorded(held: DataFrame) -> list[str]:
    """The columns that ``record`` renamed."""
    return [c for c in held.columns if re.fullmatch(r"_r\d+", c)]


def unrecord(held: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The recorded columns under their ``names`` again, replaced by or followed by ``more``."""
    back = [F.col(c) if c in more else F.col(f"_r{i}").alias(c) for i, c in enumerate(names)]
    return held.select(*back, *[c for c in more if c not in names])


# --- numpy: all words of a batch of texts at once -------------------------------------

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE_BYTES = np.zeros(256, bool)
_SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2**64."""
    out = np.full(n, BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null rows are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


PIECE = 1 << 20


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space words of many texts, each text's first word, each word's first byte.

    The second array has one entry more than there are texts.  Words do not cross
    the ends of texts.  Bytes are worked on in pieces of about a megabyte, cut
    before a word, so memory follows the number of words.
    """
    n = len(raw)
    inside = ~_SPACE_BYTES[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    starts[cuts] = inside[cuts]
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, offsets)
    out = np.empty(len(at), np.uint64)
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE)))
        end = int(at[high]) if high < len(at) else n
        out[low:high] = _hash_piece(raw[at[low] : end], inside[at[low] : end], at[low:high] - at[low], lower)
        low = high
    return out, first, at


def _hash_piece(raw: np.ndarray, inside: np.ndarray, at: np.ndarray, lower: bool) -> np.ndarray:
    place = np.arange(len(raw)) - np.repeat(at, np.diff(np.append(at, len(raw))))
    codes = _BYTE[_LOWER_BYTES[raw] if lower else raw]
    codes *= powers(int(place.max()) + 1)[place]
    codes[~inside] = 0
    return mix(np.add.reduceat(codes, at))


SLICE_BYTES = 2 << 20


def slices(texts):
    """Ranges of rows of an Arrow string column, of about SLICE_BYTES, with their bytes and offsets."""
    raw, offsets = text_bytes(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high

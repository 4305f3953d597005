"""Best-fit packing of documents into sequences of bounded length, planned on a histogram.

How documents fit together depends on their lengths alone, of which there are as
many as a sequence has tokens.  So the driver packs counts: from the longest
length to the shortest, the pieces of a length go to the open sequences with the
least room that holds them, a whole group of equal sequences at a time.  The plan
says, for a range of ranks within a length, in which sequences and where these
pieces stand; every piece then looks its rank up.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from . import words as w

SEQUENCE = 2048
VOCABULARY = "byte_bpe_50k.json"  # of the public tokenizers; a path is taken as one
END = 0  # the id that ends a document
LANES = 1024
COPIES = 1024  # equal rows that are numbered at once
ROWS_PER_TASK = 500_000
CACHED_UNITS, CACHED_CHARS = 1_000_000, 64
PIECE_KEY = ["doc_id", "piece", "start", "length", "ids_crc32"]


# --- tokens ------------------------------------------------------------------------------

class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, unit by unit from a cache.

    Byte-level BPE never joins a character with a blank that follows it, so a text
    may be cut before every single blank that stands between two characters that
    are no white space, and the units encoded each for itself.  Units of up to
    CACHED_CHARS characters are kept, in two generations of about CACHED_UNITS: what
    is met again moves to the younger one, the older one goes.  Special tokens that stand in a text are encoded as the library does by
    default.
    """

    blanks = re.compile(r" (?:\s|(?<=\s.))")  # a blank beside other white space
    cut = re.compile(r"(?<=\S)(?= \S)")
    clean = re.compile(r" ?\S+")

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        if "/" not in vocabulary:
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(str(vocabulary))
        self.newline = self._ids(["\n"])[0]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, text: str) -> list[str]:
        """Keys of a text's units: without the blank that begins it, or after a newline if none does."""
        if self.blanks.search(text):
            return [u[1:] if len(u) > 1 and u[0] == " " and not u[1].isspace() else "\n" + u for u in self.cut.split(text)]
        keys = text.split(" ")
        keys[0] = "\n" + keys[0]
        return keys

    def _encode_new(self, keys: list[str]) -> dict[str, bytes]:
        """Codes by key.  Units without other white space than a blank at their start are encoded as one text, a line each: one call costs less than many."""
        unit_of = {k: k[1:] if k[:1] == "\n" else " " + k for k in keys}
        clean = [k for k in keys if k.isalnum() or self.clean.fullmatch(unit_of[k])]
        out = {}
        ids = np.array(self._ids(["\n".join(map(unit_of.get, clean))])[0], "<u4")
        ends = np.append(np.flatnonzero(ids == self.newline[0]), len(ids)) * 4
        if clean and len(self.newline) == 1 and len(ends) == len(clean):
            raw = ids.tobytes()
            out = {k: raw[a:b] for k, a, b in zip(clean, [0, *(ends[:-1] + 4).tolist()], ends.tolist())}
        rest = [k for k in keys if k not in out]
        return out | {k: struct.pack(f"<{len(x)}I", *x) for k, x in zip(rest, self._ids([unit_of[k] for k in rest]))}

    def encode(self, texts: list[str]) -> list[bytes]:
        units = [self.units(text) for text in texts]
        found = [list(map(self.known.get, us)) for us in units]
        gaps = [(us, codes, i) for us, codes in zip(units, found) for i in _gaps(codes)]
        new = {us[i] for us, _, i in gaps}
        now = {u: self.older[u] for u in new if u in self.older}
        now |= self._encode_new([u for u in new if u not in now])
        for us, codes, i in gaps:
            codes[i] = now[us[i]]
        out = list(map(b"".join, found))
        if len(self.known) > CACHED_UNITS:
            self.known, self.older = {}, self.known
        self.known |= {u: code for u, code in now.items() if len(u) <= CACHED_CHARS}
        return out


def _gaps(codes: list[bytes | None]) -> Iterator[int]:
    """Where a list holds None, which are few of its places."""
    at = -1
    for _ in range(codes.count(None)):
        at = codes.index(None, at + 1)
        yield at


def worker_encoder(vocabulary: str) -> Encoder:
    """One encoder per Python worker: Spark runs many tasks in a worker, and each finds the units of those before."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_pagewright_encoders", {})
    if vocabulary not in held:
        held[vocabulary] = Encoder(vocabulary)
    return held[vocabulary]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, most: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): documents as pieces of at most ``most`` tokens.

    A document is the ids of its text and then ``end``; a null or empty text is the
    end alone.  Longer ones are cut from the end, so that all pieces but the first
    are full.  ``ids`` are little-endian unsigned 32-bit numbers.  A null doc_id and
    repeated rows are documents like any other; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        last = np.array([end], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for low, high, raw, offsets in w.slices(batch.column("text")):
                blob = raw.tobytes()
                texts = [blob[a:b].decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                out = []
                for doc, ids in zip(batch.column("doc_id").slice(low, high - low).to_pylist(), encoder.encode(texts)):
                    ids += last
                    n = len(ids) // 4
                    bounds = [0, *range(n % most or most, n + 1, most)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        part = ids[4 * a : 4 * b]
                        out.append((doc, piece, a, b - a, zlib.crc32(part), part))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


# --- plan --------------------------------------------------------------------------------

PLAN = ["length", "rank", "n", "sequence", "offset", "each"]


def plan(histogram: Mapping[int, int], most: int = SEQUENCE) -> pd.DataFrame:
    """Best fit by decreasing length over counts: rows of PLAN, sorted by length and rank.

    The pieces of rank ``rank`` to ``rank + n - 1`` of a length go to sequences from
    ``sequence`` on, ``each`` to a sequence, from ``offset`` on.  Equal sequences are
    kept as ranges (first, count) by the room they have left.  A step leaves a range
    less room than the length it placed, and a length splits one range at most, so
    the plan's size is bounded by ``most``, whatever the counts are.
    """
    rows: list[tuple[int, ...]] = []
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        room = length
        while left:
            while room < most and not rooms[room]:
                room += 1
            each = room // length
            if rooms[room]:
                first, count = rooms[room].pop()
            else:  # none has room: open as many as are needed
                first, count = opened, -(-left // each)
                opened += count
            full = min(count, left // each)
            rest = min(left - full * each, each) if full < count else 0
            if full:
                rows.append((length, rank, full * each, first, most - room, each))
                rooms[room - each * length].append((first, full))
            if rest:
                rows.append((length, rank + full * each, rest, first + full, most - room, rest))
                rooms[room - rest * length].append((first + full, 1))
            if full + (rest > 0) < count:
                rooms[room].append((first + full + (rest > 0), count - full - (rest > 0)))
            rank += full * each + rest
            left -= full * each + rest
    return pd.DataFrame(rows, columns=PLAN).sort_values(["length", "rank"], ignore_index=True)


def place(planned: pd.DataFrame, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    # Lengths and ranks in one sorted key: the plan's first row of each length, then its ranks.
    first = np.searchsorted(planned["length"], length, "left")
    ranks = planned["rank"].to_numpy() + planned["length"].to_numpy().astype(np.int64) * 2**46
    row = np.searchsorted(ranks, rank + length * 2**46, "right") - 1
    assert (row >= first).all()
    sequence, offset, each, start = (planned[c].to_numpy()[row] for c in ("sequence", "offset", "each", "rank"))
    place = rank - start
    return sequence + place // each, offset + place % each * length


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """PIECE_KEY and ``rank``, 0, 1, ... within the pieces of a length; there are ``total`` of them.

    Equal rows are counted first and numbered in blocks, so that no task gets all
    of a group of copies.  Numbers run through 1,024 lanes of a length and within
    each lane by the rows' values: the same rows get the same ranks in any layout.
    """
    counted = pieces.groupBy(*PIECE_KEY).agg(F.count("*").alias("_n"))
    laned = counted.withColumn("_lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(LANES)).cast("int"))
    lanes = laned.groupBy("length", "_lane").agg(F.sum("_n").alias("_lane_n"))
    before = F.sum("_lane_n").over(Window.partitionBy("length").orderBy("_lane")) - F.col("_lane_n")
    within = F.sum("_n").over(Window.partitionBy("length", "_lane").orderBy("doc_id", "piece", "start", "ids_crc32")) - F.col("_n")
    numbered = laned.withColumn("_within", within).join(lanes.withColumn("_before", before).drop("_lane_n"), ["length", "_lane"])
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))).alias("_block")
    blocks = numbered.select(*PIECE_KEY, "_n", (F.col("_before") + F.col("_within")).alias("_first"), block)
    low = F.col("_block") * COPIES
    copy = F.explode(F.sequence(low, F.least(low + COPIES, F.col("_n")) - 1)).alias("_copy")
    # Adaptive execution would judge the blocks by the few bytes they have before they are expanded.
    dealt = blocks.repartition(max(8, -(-total // ROWS_PER_TASK)), "ids_crc32", "doc_id", "_block")
    return dealt.select(*PIECE_KEY, "_first", copy).select(*PIECE_KEY, (F.col("_first") + F.col("_copy")).alias("rank"))


def packed(pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """PIECE_KEY, sequence_id and offset of all pieces, in as few sequences as best fit by decreasing length needs.

    The driver sees one count per length, and tasks the plan made of these.  Pieces
    of a sequence stand one after another from 0 on.  No pieces give no rows.
    """
    slim = pieces.select(*PIECE_KEY)
    counts = {r.length: r.n for r in slim.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = plan(counts, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = place(planned, length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PIECE_KEY), pa.array(sequence), pa.array(offset)], names=[*PIECE_KEY, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in slim.dtypes) + ", sequence_id long, offset long"
    return ranked(slim, sum(counts.values())).mapInArrow(run, schema)


def stored(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, most: int = SEQUENCE) -> DataFrame:
    """``tokenized`` documents in a file of the shared folder, since lengths, places and ids are read one after another."""
    return stage(tokenized(docs, vocabulary, end, most), "tokens")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of all sequences, from stored pieces and their ``packed`` places.

    Equal rows have equal ids, so one of them serves all their places.  A sequence
    has ``most`` ids at most, so no group grows with the data.
    """
    held = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PIECE_KEY]
    ids = pieces.groupBy(*[F.col(c).alias(f"_{c}") for c in PIECE_KEY]).agg(F.first("ids").alias("ids"))
    joined = places.join(ids, held)
    return joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.expr("listagg(ids) WITHIN GROUP (ORDER BY offset)").alias("ids"))

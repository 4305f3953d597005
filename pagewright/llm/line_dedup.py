"""Line dedup: a line goes if an earlier one equals it or differs by one word.

Equal lines are one class, represented by the earliest.  Two classes within one
edit share a key of their deletion neighbourhood: the line itself or the line
less one word.  Keys are hashed, and groups of equal keys are reduced to their
earliest lines, never to pairs: all lines that agree but for the word at one
place are within one edit of each other, so the earliest decides for all.  The
pairs that are left are verified on the words.

Neighbourhoods are only made for lines that share their first or their last half
with another line, which one edit cannot avoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import let
from ..session import stage
from . import words as w

LEAST_WORDS = 5
_BACK = np.uint64(pow(int(w.BASE), -1, 2**64))
_FRONT_SIDE, _BACK_SIDE, _SECOND = (np.uint64(x) for x in (0x1F123BB5, 0x2E1B2138, 0x5851F42D))
LINES = "doc_id long, text_hash long, line int, n int, h1 long, h2 long, halves array<long>"
VARIANTS = "lid long, words array<string>, keys array<long>"


class _Lines:
    """The lines with words of a slice of texts, as ranges of word hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.hashes, first, at = w.word_hashes(raw, offsets)
        feeds = np.append(0, np.cumsum(raw == 0x0A))
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        line = feeds[at] - feeds[offsets[text]]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        self.starts = np.flatnonzero(fresh)
        self.text, self.line = text[self.starts], line[self.starts].astype(np.int32)
        self.n = np.diff(np.append(self.starts, len(at)))
        place = np.arange(len(at)) - np.repeat(self.starts, self.n)
        self.power = w.powers(int(self.n.max()) + 1 if len(self.n) else 1)
        self.back = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(self.power) - 1, _BACK, np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(self.hashes * self.power[place]))
        self.second = np.append(np.uint64(0), np.cumsum(w.mix(self.hashes ^ _SECOND) * self.power[place]))

    def front(self, words: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """A hash of the first ``words`` words of each line."""
        sums = self.sums if sums is None else sums
        return sums[self.starts + words] - sums[self.starts]

    def halves(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first and of the last ``words`` words of each line."""
        rest = self.n - words
        last = (self.front(self.n) - self.front(rest)) * self.back[rest]
        size = words.astype(np.uint64)
        return w.mix(self.front(words) ^ w.mix(size + _FRONT_SIDE)), w.mix(last ^ w.mix(size + _BACK_SIDE))


def _line_rows(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, _, raw, offsets in w.slices(batch.column(2)):
            found = _Lines(raw, offsets)
            size = found.n.astype(np.uint64)
            h1, h2 = w.mix(found.front(found.n) ^ w.mix(size)), w.mix(found.front(found.n, found.second) ^ w.mix(size))
            small, large = (found.n - 1) // 2, found.n // 2
            keys = np.stack([*found.halves(large), *found.halves(small)], axis=1)
            # Lines of an odd number of words have their halves once, too short ones none.
            count = np.where(found.n < least_words, 0, np.where(small == large, 2, 4))
            bounds = np.append(0, np.cumsum(count)).astype(np.int32)
            flat = keys[np.arange(4) < count[:, None]]
            rows = pa.array(low + found.text)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.line), pa.array(found.n.astype(np.int32)),
                pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))], ["doc_id", "text_hash", "line", "n", "h1", "h2", "halves"])


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every wanted line its words and keys: of the whole line, then of the line less each word."""
    for batch in batches:
        for low, high, raw, offsets in w.slices(batch.column(1)):
            found = _Lines(raw, offsets)
            n = found.n
            size = n.astype(np.uint64)
            of = np.repeat(np.arange(len(n)), n + 1)
            slot = np.arange(len(of)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)  # 0: whole, i: less word i - 1
            at = np.maximum(slot - 1, 0)
            start = found.starts[of]
            before = found.sums[start + at] - found.sums[start]
            after = (found.sums[start + n[of]] - found.sums[np.minimum(start + at + 1, len(found.sums) - 1)]) * _BACK
            whole = found.front(n)[of]
            keys = w.mix(np.where(slot == 0, whole, before + after) ^ w.mix(size[of] - (slot > 0).astype(np.uint64)))
            texts, ids = batch.column(1).slice(low, high - low).to_pylist(), batch.column(0).slice(low, high - low).take(pa.array(found.text))
            words = [_lower_words(texts[t]) for t in found.text]
            bounds = pa.array(np.append(0, np.cumsum(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.list_(pa.string())), pa.ListArray.from_arrays(bounds, pa.array(keys.view(np.int64)))],
                                             ["lid", "words", "keys"])


def _lower_words(line: str) -> list[str]:
    return [x.decode() for x in line.encode().lower().split()]


def near_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The line classes of ``docs`` (doc_id, text).

    A line is what stands between newlines and has a word; lines compare by their
    words with A-Z lower-cased.  Lines of at least ``least_words`` words (two or more) may differ from an
    earlier line by one word more, fewer or other; shorter ones must equal it.
    Earlier is a lower (doc_id, hash of the text, line number), null first; a row
    repeated exactly is the same document and keeps what its double keeps.

    Columns: doc_id, text_hash, line of the first occurrence, and near: whether an
    earlier line is within one edit.
    """
    if least_words < 2:
        raise ValueError("least_words must be 2 or more: lines of one word have no halves")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    lines = stage(slim.mapInArrow(partial(_line_rows, least_words=least_words), LINES), "lines")
    place = F.struct("doc_id", "text_hash", "line")
    classes = lines.groupBy("h1", "h2").agg(F.min(F.struct(place.alias("first"), "n", "halves")).alias("m"))
    classes = stage(classes.select("m.first", "m.n", "m.halves", F.monotonically_increasing_id().alias("lid")), "line-classes")

    halves = classes.select("lid", F.explode("halves").alias("key"))
    shared = halves.groupBy("key").agg(F.min("lid").alias("_low"), F.max("lid").alias("_high")).filter("_low < _high")
    paired = stage(halves.join(shared.select("key"), "key", "left_semi").select("lid").distinct(), "paired")
    wanted = classes.join(paired, "lid", "left_semi").select("lid", "first")
    near = _near_classes(_line_texts(slim, wanted), wanted)
    marked = classes.select("lid", "first").join(near.withColumn("near", F.lit(True)), "lid", "left")
    return marked.select("first.*", F.coalesce("near", F.lit(False)).alias("near"))


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lid, line) of the wanted classes' first lines; documents are read again for the lines they hold."""
    by_doc = wanted.select("first.doc_id", "first.text_hash", F.struct(F.col("first.line").alias("line"), "lid").alias("at"))
    held = by_doc.groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("_at"))
    same_row = docs["doc_id"].eqNullSafe(held["doc_id"]) & (docs["text_hash"] == held["text_hash"])
    rows = docs.join(held, same_row).withColumn("_lines", F.split("text", "\n", -1)).select("_lines", F.explode("_at").alias("at"))
    return rows.select("at.lid", F.element_at("_lines", F.col("at.line") + 1).alias("line")).dropDuplicates(["lid"])


def _near_classes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """lid of the lines that have an earlier line within one edit."""
    variants = stage(texts.mapInArrow(_variant_rows, VARIANTS), "variants")
    keys = variants.select("lid", F.posexplode("keys").alias("slot", "key"))
    met = keys.groupBy("key").agg(F.min("lid").alias("_low"), F.max("lid").alias("_high")).filter("_low < _high").select("key")
    hits = stage(keys.join(met, "key", "left_semi").join(wanted, "lid").select("key", "slot", "lid", F.struct("first", "lid").alias("who")), "variant-hits")
    same_place = hits.filter("slot > 0").groupBy("key", "slot").agg(F.min("who").alias("who"))
    whole = hits.filter("slot = 0").groupBy("key").agg(F.min("who").alias("who"))
    longer = hits.filter("slot > 0").groupBy("key").agg(F.min("who").alias("who"))
    mine = hits.select("key", "slot", "lid")
    offers = (mine.join(same_place, ["key", "slot"]).select("lid", "who")
              .unionByName(mine.filter("slot > 0").join(whole, "key").select("lid", "who"))
              .unionByName(mine.filter("slot = 0").join(longer, "key").select("lid", "who")))
    best = offers.groupBy("lid").agg(F.min("who").alias("who")).join(wanted, "lid").filter(F.col("who")["first"] < F.col("first"))
    pairs = best.select("lid", F.col("who")["lid"].alias("other"))
    words = variants.select("lid", "words")
    both = pairs.join(words, "lid").join(words.select(F.col("lid").alias("other"), F.col("words").alias("theirs")), "other")
    return both.filter(_within_one_edit("words", "theirs")).select("lid")


def _within_one_edit(a: str, b: str):
    """Whether word lists differ by at most one word: what agrees in front and at the back leaves one over."""
    longest = F.greatest(F.size(a), F.size(b))

    def agreeing(x, y):
        equal = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        return F.coalesce(F.nullif(F.array_position(equal, F.lit(False)), F.lit(0)), longest + 1) - 1

    front, back = agreeing(F.col(a), F.col(b)), agreeing(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (front + back + 1 >= longest)


def _rewritten(docs: DataFrame, least_words: int) -> DataFrame:
    """The rows of ``docs``, recorded, with _rest (text less the lines that go), _all, _first and _near (counts of lines).

    Numbers of kept lines and of blank ones are sorted together and the lines
    taken by number, so the work follows the lines of a text.
    """
    classes = near_lines(docs.select("doc_id", "text"), least_words)
    held = classes.groupBy(F.struct("doc_id", "text_hash").alias("_key")).agg(
        F.collect_list(F.when(~F.col("near"), F.col("line"))).alias("_kept"), F.count("*").alias("_first"), F.count_if("near").alias("_near"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    joined = w.record(docs, _text=F.col("text"), _key=key).join(held, "_key", "left")
    lined = let(joined, _lines=F.split("_text", "\n", -1))
    numbers = F.transform("_lines", lambda x, i: F.when(~x.rlike(w.NOT_SPACE), i))
    blank = let(lined, _blank=F.filter(numbers, lambda i: i.isNotNull()))
    stay = F.array_sort(F.concat("_blank", F.coalesce("_kept", F.array().cast("array<int>"))))
    counts = {"_all": F.size("_lines") - F.size("_blank"), "_first": F.col("_first"), "_near": F.col("_near")}
    counts = {name: F.coalesce(F.when(F.col("_text").isNotNull(), n), F.lit(0)).cast("long") for name, n in counts.items()}
    return blank.withColumn("_rest", F.array_join(F.transform(stay, lambda i: F.element_at("_lines", i + 1)), "\n")).withColumns(counts)


def line_report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """What is left of every row of ``docs`` (doc_id, text).

    doc_id; n_lines, n_exact, n_near, n_kept: lines with a word, those equal to an
    earlier one, those near one, the rest; text: without the lines that go.  Null
    texts count 0 and stay null; a text that loses all its lines is empty.
    """
    out = _rewritten(docs.select("doc_id", "text"), least_words)
    return out.select(F.col("_r0").cast("long").alias("doc_id"), F.col("_all").alias("n_lines"), (F.col("_all") - F.col("_first")).alias("n_exact"),
                      F.col("_near").alias("n_near"), (F.col("_first") - F.col("_near")).alias("n_kept"), F.col("_rest").alias("text"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with their texts less the lines that go; lines without words and null texts stay."""
    out = _rewritten(docs, least_words)
    return w.unrecord(out.withColumn("text", F.col("_rest")), docs.columns, "text")

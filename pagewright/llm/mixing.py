"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source, document after document, are packed into blocks.  Each
output shard gets a random number of slots per source, multinomial under the
source's exact slot total; slot k of a source reads the block that a
pseudorandom permutation of the source's block numbers gives for k, epoch after
epoch; slots and blocks meet in a join by (source, block).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from . import words as w

BLOCK_WORDS = 128
SLOTS_PER_SHARD = 8192
SHARDS_PER_GROUP = 64
SLOTS_PER_TASK = 200_000
SLOTS_AT_ONCE = 65_536
ROWS_PER_TASK = 500_000
COPIES = 1024
LANES = 1024
ONE = 1 << 20  # a whole copy, in the units that fractions are summed in
WEIGHTS = (3, 1, 2)


def n_words(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(w.NOT_SPACE + "+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Per source: sid, source, source_size and target.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` of all words by weight.  A target stops at ``most`` times its
    source's words; what exceeds it is shared again among the others.  So the
    targets are min(cap, level * weight) for the one level that spends all: with
    the sources sorted by cap / weight, the level that holds from each source on
    is known from running sums, and it is the true one from the first source that
    it leaves below its cap.  The windows without partition run over one row per
    source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    weight = F.element_at(F.lit([float(x) for x in weights]), F.col("sid") % len(weights) + 1)
    caps = ranked.withColumns({"_weight": weight, "_cap": F.col("source_size") * most})
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = Window.orderBy(F.col("_cap") / F.col("_weight"), "sid")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    levels = caps.withColumn("_level", left / F.sum("_weight").over(after))
    open_level = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    sorted_all = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.coalesce(F.first(open_level, ignorenulls=True).over(sorted_all), F.lit(math.inf))
    target = F.least("_cap", level * F.col("_weight"))
    return levels.withColumn("target", target).select("sid", "source", "source_size", "target")


def word_spans(sized: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Where each document lies in its source's blocks.

    From (sid, _row, size): sid, idx, _row, first_word of the document in the
    block, and the half-open range [at, until) in the block.  The position of a
    document is a prefix sum in two levels, over 1,024 lanes of a source and within
    each, so a source that holds most rows is summed by many tasks.
    """
    laned = sized.filter("size > 0").withColumn("_lane", F.pmod(F.xxhash64("_row"), F.lit(LANES)).cast("int"))
    lanes = laned.groupBy("sid", "_lane").agg(F.sum("size").alias("_n"))
    started = lanes.withColumn("_base", F.sum("_n").over(Window.partitionBy("sid").orderBy("_lane")) - F.col("_n")).drop("_n")
    within = Window.partitionBy("sid", "_lane").orderBy("_row")
    placed = laned.withColumn("_in", F.sum("size").over(within) - F.col("size")).join(started, ["sid", "_lane"])
    begin = F.col("_base") + F.col("_in")
    spans = placed.select("sid", "_row", "size", begin.alias("_begin"), (begin + F.col("size")).alias("_end"))
    first, last = F.floor(F.col("_begin") / block), F.floor((F.col("_end") - 1) / block)
    blocks = spans.select("*", F.explode(F.sequence(first, last)).alias("idx"))
    low, high = F.greatest("_begin", F.col("idx") * block), F.least("_end", (F.col("idx") + 1) * block)
    return blocks.select("sid", "idx", "_row", (low - F.col("_begin")).alias("first_word"), (low - F.col("idx") * block).alias("at"),
                         (high - F.col("idx") * block).alias("until"))


def permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 at the places ``k``.

    Four Feistel rounds on the smallest even number of bits that can count to n;
    results of n and above go round again until they fall below it.
    """
    if n <= 1:
        return np.zeros_like(k)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for turn in range(4):
            salt = np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
            left, right = right, left ^ (w.mix(right + salt) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def mixture_slots(targets: DataFrame, block: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 7) -> DataFrame:
    """The slots of the mix: sid, idx, epoch, shard, slot, take (words taken of the block).

    In an epoch a source's whole blocks come in permuted order, its short last
    block at the end; the last slot of all takes only what the target lacks.  So a
    source's slots take its target to the word, no word more than ceil(target /
    size) times.  A multinomial draw over all shards is one over groups of shards
    and then one within each group, so a source's slots are counted out for its
    groups first, and drawn and expanded group by group on as many tasks as there
    are slots for.
    """
    rounded = targets.filter("source_size > 0 AND target >= 0.5").select("sid", "source_size", F.round("target").cast("long").alias("target"))
    per_epoch = F.ceil(F.col("source_size") / block)
    rest = F.ceil((F.col("target") % F.col("source_size")) / block)
    counted = rounded.withColumn("slots", F.floor(F.col("target") / F.col("source_size")) * per_epoch + rest)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shards = counted.withColumn("shards", F.ceil(F.sum("slots").over(everything) / slots_per_shard))

    def groups_of(shards: int) -> np.ndarray:
        return np.diff(np.append(np.arange(0, shards, SHARDS_PER_GROUP), shards))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                sizes = groups_of(row.shards)
                counts = np.random.default_rng([seed, row.sid]).multinomial(row.slots, sizes / row.shards)
                group = np.flatnonzero(counts)
                yield pd.DataFrame({"sid": row.sid, "source_size": row.source_size, "target": row.target, "shards": row.shards, "group": group,
                                    "first": (np.cumsum(counts) - counts)[group], "n": counts[group]})

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                size, whole = int(row.source_size), int(row.source_size) // block
                blocks = -(-size // block)
                members = groups_of(row.shards)[row.group]
                counts = np.random.default_rng([seed, row.sid, row.group]).multinomial(row.n, np.full(members, 1 / members))
                ends = np.cumsum(counts)
                for low in range(0, row.n, SLOTS_AT_ONCE):
                    at = np.arange(low, min(low + SLOTS_AT_ONCE, row.n))
                    shard = row.group * SHARDS_PER_GROUP + np.searchsorted(ends, at, "right")
                    k = row.first + at
                    epoch, place = k // blocks, k % blocks
                    idx = np.where(place < whole, permute(np.minimum(place, max(whole - 1, 0)), whole, row.sid + (seed << 20)), place)
                    length = np.minimum(block, size - place * block)
                    take = np.minimum(length, row.target - (epoch * size + place * block))
                    yield pd.DataFrame({"sid": row.sid, "idx": idx, "epoch": epoch, "shard": shard, "slot": k, "take": take})

    slots = targets.agg(F.sum(F.col("target") / block)).first()[0] or 0
    drawn = shards.mapInPandas(draw, "sid int, source_size long, target long, shards long, group long, first long, n long")
    # Adaptive execution would judge the groups by the few bytes they have before they are expanded.
    dealt = drawn.repartition(max(8, int(slots) // SLOTS_PER_TASK), "sid", "group")
    return dealt.mapInPandas(expand, "sid int, idx long, epoch long, shard long, slot long, take long")


def numbered_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, size and _row, a value of its own for each row of ``docs``.

    _row is made of the content and an ordinal among equal rows, so it is the same
    in any layout of the files.  Equal rows are counted and written out again in
    blocks, so that many of them burden no one task.
    """
    key = ["doc_id", "text_hash", "source", "size"]
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", n_words().alias("size"))
    counted = stage(slim.groupBy(*key).agg(F.count("*").alias("_n")), "sizes")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES)))
    low = F.col("_block") * COPIES
    copy = F.explode(F.sequence(low, F.least(low + COPIES, F.col("_n")) - 1))
    dealt = counted.withColumn("_block", block).repartition(max(8, total // ROWS_PER_TASK), "text_hash", "doc_id", "_block")
    return dealt.select(*key, copy.alias("_copy")).select(*key, F.struct("doc_id", "text_hash", "_copy").alias("_row"))


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(sized documents, mix).

    The first has doc_id, text_hash, source, size, _row (see ``numbered_rows``),
    sid, source_size and target for every row; the second one row per piece of
    the mix: shard, slot, sid, epoch, _row, first_word, n_words, in the order of
    which a shard is read.  Both follow from the rows alone, not from how they are
    stored or dealt out.  Null and empty texts are sized 0 and take no part;
    a null source is a source; rows with one doc_id are told apart by _row.
    """
    numbered = numbered_rows(docs)
    targets = stage(source_targets(numbered), "targets")
    sized = numbered.join(targets, numbered["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    slots = mixture_slots(targets, block, seed=seed)
    # The planner sizes the slots by the few rows they are expanded from; they must not be broadcast.
    joined = word_spans(sized, block).join(slots.hint("merge"), ["sid", "idx"]).filter(F.col("take") > F.col("at"))
    pieces = joined.withColumn("n_words", F.least("until", "take") - F.col("at"))
    return sized, pieces.select("shard", "slot", "sid", "epoch", "_row", "first_word", "n_words")


def _taken(docs: DataFrame, seed: int) -> DataFrame:
    sized, pieces = mix(docs, seed)
    taken = pieces.groupBy("sid", "_row").agg(F.sum("n_words").alias("taken"), F.count_distinct("shard").alias("n_shards"))
    both = sized.join(taken, ["sid", "_row"], "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("taken", "n_shards")})


def taken_words(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken and n_shards (shards with words of it) for every row of ``docs``."""
    return _taken(docs, seed).select("doc_id", "text_hash", "size", "source_size", "target", "taken", "n_shards")


def whole_copies(shares: DataFrame, seed: int = 7) -> DataFrame:
    """_key and _copies of (_key, sid, taken, size): taken / size rounded up or down, so that a source's words stay.

    Every document has floor(taken / size) copies and perhaps one more: the
    fractions that are left are summed along documents of about one size (eight
    classes to a doubling), and where the sum passes a whole number a copy is
    added.  What a class still owes at its end, in words, opens the next larger
    one as a fraction of its documents, so a source is off by about one document
    at most.  The sums are prefix sums in two levels, over 1,024 lanes of a class
    and within each, of whole numbers, so that their order does not matter.
    """
    over = F.col("taken") % F.col("size")
    left = F.floor(over * F.lit(ONE) / F.col("size")).cast("long")
    laned = shares.filter("size > 0").withColumns({"_left": left, "_class": F.floor(F.log2("size") * 8).cast("int"),
                                                   "_lane": F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(LANES)).cast("int")})
    lanes = laned.groupBy("sid", "_class", "_lane").agg(F.sum("_left").alias("_n"), F.sum(over).alias("_words"))
    before = F.sum("_n").over(Window.partitionBy("sid", "_class").orderBy("_lane")) - F.col("_n")
    opened = lanes.withColumn("_before", before).join(class_openings(lanes), ["sid", "_class"], "left")
    started = opened.select("sid", "_class", "_lane", (F.coalesce("_open", F.lit(0)) + F.col("_before")).alias("_base"))
    within = F.sum("_left").over(Window.partitionBy("sid", "_class", "_lane").orderBy("_key"))
    summed = laned.withColumn("_in", within).join(started, ["sid", "_class", "_lane"]).withColumn("_end", F.col("_base") + F.col("_in"))
    more = F.floor(F.col("_end") / ONE) - F.floor((F.col("_end") - F.col("_left")) / ONE)
    return summed.select("_key", (F.floor(F.col("taken") / F.col("size")) + more).cast("int").alias("_copies"))


def class_openings(lanes: DataFrame) -> DataFrame:
    """sid, _class and _open: the fraction, in units of ONE, that a class of documents opens with.

    A source has some hundred classes at most, which are walked in one expression.
    The first opens with half a document.
    """
    classes = lanes.groupBy("sid", "_class").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words")).filter("_n > 0")
    ordered = classes.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("_class", "_n", "_words"))).alias("cs"))

    def step(done, c):
        length = c["_words"] * F.lit(float(ONE)) / c["_n"]  # of the class's documents, in words
        begin = F.when(F.size(done["open"]) == 0, F.lit(ONE / 2)).otherwise(done["owed"] * F.lit(float(ONE)) / length)
        begin = F.floor(begin).cast("long")
        rest = (begin + c["_n"]) % ONE
        one = F.struct(c["_class"].alias("_class"), begin.alias("_open"))
        return F.struct((rest * length / F.lit(float(ONE))).alias("owed"), F.concat(done["open"], F.array(one)).alias("open"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<_class:int,_open:bigint>>").alias("open"))
    walked = F.aggregate("cs", start, step, lambda done: done["open"])
    return ordered.select("sid", F.inline(walked))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` as often as the mix takes them: a row per whole text, see ``whole_copies``.

    So a document that the mix passes over or that has no words goes, and one it
    reads twice comes twice; the words of a source come to what the mix takes of
    it but for a few documents.  Rows equal in doc_id and text share what they take.
    """
    taken = _taken(docs, seed).groupBy(F.struct("doc_id", "text_hash").alias("_key"))
    # Read for the lanes' sums and for the documents.
    shares = stage(taken.agg(F.min("sid").alias("sid"), F.sum("taken").alias("taken"), F.sum("size").alias("size")), "shares")
    often = whole_copies(shares, seed).filter("_copies > 0")
    keyed = w.record(docs, _key=F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    return w.unrecord(keyed.join(often, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs.columns)

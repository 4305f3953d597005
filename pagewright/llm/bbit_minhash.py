"""Near duplicates by b-bit MinHash.

128 minima per shingle set make 25 band keys of five minima each; the low four
bits of all minima are packed into eight 64-bit words.  Texts with one shingle
set are one class from the start.  Classes that share a band key are compared by
the bit counts of their packed words, corrected for chance collisions, and what
may be similar is confirmed on the full shingle sets.

The classes that share a band key are first compared with one of them, a hub, and
those found linked become one component; so copies of one text, however many,
take a comparison each.  Only what the hubs have not joined is then compared
across components; that join confirms its pairs itself and gives out links alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import words as w
from .components import components

SHINGLE = 5
HASHES, BANDS, ROWS, BITS = 128, 25, 5, 4
PACKED = HASHES * BITS // 64
SIMILAR = 85  # per cent, where the caller does not say
DEVIATIONS = 5
HUB_TURNS = 2

_RNG = np.random.Generator(np.random.PCG64(8128))
_A, _B = (_RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1) for _ in "ab")
_PLACE = w.mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_SHORT = w.mix(np.arange(100, 100 + SHINGLE, dtype=np.uint64))
_BAND = w.mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of many texts, one after another, and their counts.

    A-Z is lower-cased.  A text of fewer than five words has its whole sequence as
    its one shingle, one without words none.
    """
    hashes, first, _ = w.word_hashes(raw, offsets)
    n = np.diff(first)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    rolled = np.zeros(len(hashes), np.uint64)
    for j in range(SHINGLE):
        rolled += padded[j : j + len(hashes)] * _PLACE[j]
    rolled = w.mix(rolled)
    sets = []
    for begin, count in zip(first[:-1].tolist(), n.tolist()):
        if count >= SHINGLE:
            sets.append(np.unique(rolled[begin : begin + count - SHINGLE + 1]))
        elif count:
            whole = (hashes[begin : begin + count] * _PLACE[:count]).sum(dtype=np.uint64)
            sets.append(w.mix(np.array([whole ^ _SHORT[count]], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def minima(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The HASHES minima of each set (none empty), in pieces that stay in the CPU's cache."""
    ends = np.cumsum(sizes)
    out = np.full((len(sizes), HASHES), 2**32 - 1, np.uint32)
    for low in range(0, len(values), 1 << 14):
        high = min(low + (1 << 14), len(values))
        one, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right")
        starts = np.maximum(np.append(0, ends)[one : last + 1] - low, 0)
        x, y = values[low:high].astype(np.uint32), (values[low:high] >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            least = np.minimum.reduceat(x * _A[k] + y * _B[k], starts)
            np.minimum(out[one : last + 1, k], least, out=out[one : last + 1, k])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, of the band's number and its minima."""
    keys = np.tile(_BAND, (len(signature), 1))
    for i in range(ROWS):
        keys = w.mix(keys ^ signature[:, i : BANDS * ROWS : ROWS].astype(np.uint64)) + np.uint64(i)
    return keys


def packed(signature: np.ndarray) -> np.ndarray:
    """The low bits of all minima, sixteen to a 64-bit word."""
    low = (signature & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(signature), PACKED, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


FEATURES = "doc_id long, text_hash long, n long, h1 long, h2 long, bands array<long>, packed array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for low, high, raw, offsets in w.slices(texts):
            values, sizes = shingle_sets(raw, offsets)
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            h1, h2 = np.zeros(high - low, np.uint64), np.zeros(high - low, np.uint64)
            bands, bits = np.zeros((high - low, BANDS), np.uint64), np.zeros((high - low, PACKED), np.uint64)
            if len(some):
                h1[some] = np.add.reduceat(w.mix(values), starts)
                h2[some] = np.add.reduceat(w.mix(values ^ _BAND[0]), starts)
                signature = minima(values, sizes[some])
                bands[some], bits[some] = band_keys(signature), packed(signature)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                _lists(bands), _lists(bits)], ["doc_id", "text_hash", "n", "h1", "h2", "bands", "packed"])


def _lists(rows: np.ndarray) -> pa.Array:
    bounds = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(rows.reshape(-1).view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, raw, offsets in w.slices(batch.column(1)):
            values, sizes = shingle_sets(raw, offsets)
            bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64)))],
                ["cid", "shingles"])


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures, corrected for low bits that agree by chance.

    The bits in which two words differ are folded into the lowest bit of each
    group of four, so a bit count gives the minima that differ.
    """
    ones = int("1" * (64 // BITS), 16)
    differ = F.lit(0)
    for i in range(PACKED):
        x = F.col(f"{a}_{i}").bitwiseXOR(F.col(f"{b}_{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(ones))
        differ = differ + F.bit_count(x)
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def least_estimate(similar: int) -> float:
    """The estimate that a pair at the bound of ``similar`` per cent stays above but for five deviations, rounded down: 0.68 at 85, 0.61 at 80."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * similar / 100
    deviation = math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)
    return math.floor(100 * (similar / 100 - DEVIATIONS * deviation)) / 100


def _similar_sizes(n: str, m: str, similar: int) -> Column:
    return (100 * F.least(n, m)) >= (similar * F.greatest(n, m))


def _side(members: DataFrame, name: str, *more: str) -> DataFrame:
    return members.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("cid", "label", "n", *more)],
                          *[F.col("packed")[i].alias(f"{name}_{i}") for i in range(PACKED)])


def _may_link(similar: int) -> Column:
    return (F.col("a_label") != F.col("b_label")) & _similar_sizes("a_n", "b_n", similar) & (estimate("a", "b") >= least_estimate(similar))


def hub_candidates(members: DataFrame, turn: int, similar: int) -> DataFrame:
    """Pairs (a, b) of each band key's members with one of them, which one being drawn anew each turn."""
    order = F.xxhash64("cid", F.lit(turn)) if turn else F.col("cid")
    rank = F.struct(order.alias("order"), F.col("cid"))
    hubs = members.groupBy("key").agg(F.min(rank)["cid"].alias("cid"))
    hub = _side(members.join(hubs, ["key", "cid"]), "b")
    pairs = _side(members, "a").join(hub, "key").filter(_may_link(similar))
    return pairs.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()


def _shares_enough(a: str, b: str, similar: int) -> Column:
    """common >= ``similar`` % of the union, the union being the sum of the sizes less what is common."""
    return (100 + similar) * F.size(F.array_intersect(a, b)) >= similar * (F.size(a) + F.size(b))


def cross_links(members: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """All links (a, b) between members of a band key whose components differ.

    Members without any partner of a high enough estimate are left out first; the
    shingle sets of the others travel with them, so that the join itself confirms
    its pairs and only links come out of it.
    """
    left, right = _side(members, "a"), _side(members, "b").withColumnRenamed("key", "b_key")
    found = left.join(right, (F.col("key") == F.col("b_key")) & _may_link(similar), "left_semi")
    live = stage(members.join(found.select("key", F.col("a_cid").alias("cid")), ["key", "cid"], "left_semi"), "live")
    held = live.join(sets, "cid")
    left, right = (_side(held, x, "shingles") for x in "ab")
    pairs = left.join(right, "key").filter((F.col("a_cid") < F.col("b_cid")) & _may_link(similar) & _shares_enough("a_shingles", "b_shingles", similar))
    return pairs.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs whose shingle sets share at least ``similar`` % of their union."""
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("_a")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("_b")), "b")
    return both.filter(_shares_enough("_a", "_b", similar)).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their components' labels, of the keys that meet more than one component."""
    named = members.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high")
    return named.join(open_keys.select("key"), "key", "left_semi")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, group for every row of ``docs`` (doc_id, text).

    Two texts are near duplicates if their shingle sets share at least ``similar`` per cent of their union.
    ``group`` numbers the groups of near duplicates, null without shingles.  Null and empty texts have no shingles and are linked with nothing.  Rows that
    repeat a doc_id are one document of the graph if their texts are similar; each
    comes out.  A null doc_id gets the component of its copies, or null; it is kept
    only if it has no copy with a doc_id.  Further columns are left out.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    features = stage(slim.mapInArrow(_features, FEATURES), "features")
    same = ["h1", "h2", "n"]
    firsts = features.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("first"))
    held = features.join(firsts, same).filter(F.col("doc_id").eqNullSafe(F.col("first"))).drop("doc_id").dropDuplicates(same)
    classes = stage(held.withColumn("cid", F.monotonically_increasing_id()), "classes")

    banded = classes.select("cid", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    in_shared = stage(banded.join(shared, "key", "left_semi"), "shared-bands")
    members = stage(in_shared.join(classes.select("cid", "n", "packed"), "cid"), "members")
    wanted = classes.join(in_shared.select("cid").distinct(), "cid", "left_semi").select("cid", "first", F.col("text_hash").alias("hash"))
    sets = stage(_class_texts(slim, wanted).mapInArrow(_sets, "cid long, shingles array<long>"), "sets")

    links = None
    labels = classes.limit(0).select(F.col("cid").alias("id"), F.col("cid").alias("label"))
    for turn in range(HUB_TURNS + 1):
        named = stage(_labelled(members, labels), "open-bands")
        found = confirmed(hub_candidates(named, turn, similar), sets, similar) if turn < HUB_TURNS else cross_links(named, sets, similar)
        found = stage(found, "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    firsts = classes.select("cid", "first", *same).join(labels.withColumnRenamed("id", "cid"), "cid", "left")
    named = firsts.filter("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("component"))
    of_class = firsts.join(named, "label", "left").select(*same, F.coalesce("component", "first").alias("component_id"),
                                                          F.coalesce("label", "cid").alias("group"))
    out = features.select("doc_id", "text_hash", *same).join(of_class, same, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "group")


def deduplicated(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``docs`` with one document of each group of near duplicates (``similar`` per cent or more), with all their columns.

    The smallest doc_id stays, null last, of equal ids the text with the smallest
    hash; rows that repeat doc_id and text are one.  Texts without words stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), similar)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    best = found.filter("group IS NOT NULL").groupBy("group").agg(F.min(rank).alias("best")).select("best.doc_id", "best.text_hash")
    stay = best.unionByName(found.filter("group IS NULL").select("doc_id", "text_hash"))
    keys = stay.select(F.struct("doc_id", "text_hash").alias("_key"))
    keyed = w.record(docs, _key=F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")))
    return w.unrecord(keyed.join(keys, "_key", "left_semi").dropDuplicates(["_key"]), docs.columns)


def _class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of one document for each wanted class."""
    same_row = docs["doc_id"].eqNullSafe(wanted["first"]) & (docs["text_hash"] == wanted["hash"])
    return docs.join(wanted, same_row).dropDuplicates(["cid"]).select("cid", "text")

"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table of postings: a term, the document, the position and
the words around it.  A test phrase is looked up from its rarest terms: their
postings, moved back by the terms' offsets in the phrase, must meet in the same
document at the same start.  What meets is compared with the whole phrase in the
words that the rarest term's posting carries.  Everything is DataFrame
operations; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.frames import let
from ..operators.joins import salted_lookup
from ..session import stage
from . import words as w

WINDOW = 10
TERMS_PER_PASS = 50_000
BROADCAST_WINDOWS = 100_000


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words) of every distinct run of ``window`` words of every item.

    An item of fewer words is one window; an item without words has none.
    Columns: wid (a number of the window), item_id, words.
    """
    cut = let(items.select("item_id", "text"), words=w.term_words(F.col("text"))).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    runs = cut.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
    return runs.distinct().select(F.monotonically_increasing_id().alias("wid"), "item_id", "words")


def tokens(docs: DataFrame) -> DataFrame:
    """One row per word: the columns of ``docs`` but the text, _words, pos, term; textless rows once with null pos."""
    return docs.withColumn("_words", w.term_words(F.col("text"))).drop("text").select(
        "*", F.posexplode_outer("_words").alias("pos", "term"))


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """``terms`` in blocks of at most about TERMS_PER_PASS rows, each safe to broadcast."""
    n = max(1, -(-terms.count() // TERMS_PER_PASS))
    block = F.pmod(F.xxhash64("term"), F.lit(n))
    return [terms.filter(block == i) for i in range(n)]


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (term) occurs in all documents; 0 is left out.

    Words are matched and counted in the map tasks; only counts are shuffled.
    More terms than can be broadcast are taken in blocks, a pass for each.
    """
    found = [tokens(docs.select("text")).join(F.broadcast(block), "term").groupBy("term").agg(F.count("*").alias("n"))
             for block in _blocks(terms)]
    return reduce(DataFrame.unionByName, found)


def build_index(docs: DataFrame, terms: DataFrame | None, context: int = WINDOW - 1) -> DataFrame:
    """Store the postings of ``terms`` (all terms if None) in ``docs`` (doc, text).

    Columns: doc, n_words, term, pos, before (words carried before pos), around
    (the carried words).  Each document also has one row with a null term, so
    n_words is at hand for all.  The index is written by the tasks that cut the
    words; nothing is shuffled.
    """
    passes = [None] if terms is None else _blocks(terms)
    out = []
    for i, block in enumerate(passes):
        words = tokens(docs)
        if block is None:
            words = words.withColumn("_hit", F.col("term").isNotNull())
        else:
            words = words.join(F.broadcast(block.select("term", F.lit(True).alias("_hit"))), "term", "left")
        hit = F.coalesce("_hit", F.lit(False))
        start = F.greatest(F.col("pos") - context, F.lit(0))
        posting = F.struct(F.col("term"), F.col("pos"), (F.col("pos") - start).alias("before"),
                           F.slice("_words", start + 1, F.col("pos") - start + context + 1).alias("around"))
        first = F.coalesce(F.col("pos"), F.lit(0)) == 0 if i == 0 else F.lit(False)
        rows = words.filter(hit | first).select("doc", F.size("_words").alias("n_words"), F.when(hit, posting).alias("p"), first.alias("head"))
        # A document's first word can be a posting besides the row that stands for the document.
        both = F.when(F.col("head") & F.col("p").isNotNull(), F.array(F.col("p"), F.lit(None))).otherwise(F.array("p"))
        out.append(rows.select("doc", "n_words", F.explode(both).alias("p")).select("doc", "n_words", "p.*"))
    return stage(reduce(DataFrame.unionByName, out), "postings")


def rarest_terms(windows: DataFrame, counts: DataFrame, k: int = 2) -> DataFrame:
    """The k rarest distinct terms of each window with their first offsets: wid, rank, term, at.

    A window with a term that no document holds cannot occur and is left out.
    """
    places = windows.select("wid", F.posexplode("words").alias("at", "term"))
    firsts = places.groupBy("wid", "term").agg(F.min("at").alias("at"))
    known = firsts.join(counts, "term", "left")
    by_window = Window.partitionBy("wid")
    ranked = known.withColumn("_missing", F.max(F.col("n").isNull()).over(by_window))
    ranked = ranked.withColumn("rank", F.row_number().over(by_window.orderBy("n", "term"))).filter(~F.col("_missing"))
    return ranked.filter(F.col("rank") <= k).select("wid", "rank", "term", "at")


def _on_terms(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings joined with the windows that look for their term.

    The windows are broadcast if they are few by count; else hot terms are salted.
    """
    if wanted.count() <= BROADCAST_WINDOWS:
        return postings.join(F.broadcast(wanted), "term")
    return salted_lookup(postings, wanted, "term", F.struct("doc", "pos"), how="inner")


def phrase_matches(index: DataFrame, windows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Exact matches: doc, item_id, start (word), length, from a stored index.

    ``anchors`` are the windows' rarest terms, whose postings the index must hold.
    The lists of the two rarest terms must meet; a window of one repeated term has
    one list.
    """
    postings = index.filter("term IS NOT NULL")
    second = anchors.filter("rank = 2").select("wid", "term", "at")
    rarest = anchors.filter("rank = 1").select("wid", "term", "at").join(windows.select("wid", "item_id", "words"), "wid")
    rarest = rarest.join(second.select("wid", F.lit(True).alias("_more")), "wid", "left")
    start = (F.col("pos") - F.col("at")).alias("start")
    lists = _on_terms(postings, rarest).filter("before >= at").select(
        "doc", "wid", start, "item_id", "words", "around", (F.col("before") - F.col("at") + 1).alias("_from"), "_more")
    others = _on_terms(postings.select("doc", "term", "pos"), second).filter("pos >= at").select("doc", "wid", start)
    meet = lists.filter("_more").join(others, ["doc", "wid", "start"], "left_semi")
    found = meet.unionByName(lists.filter("_more IS NULL"))
    exact = found.filter(F.slice("around", F.greatest("_from", F.lit(1)), F.size("words")) == F.col("words"))
    return exact.select("doc", "item_id", "start", F.size("words").alias("length"))


def proximity_matches(index: DataFrame, windows: DataFrame, anchors: DataFrame, slop: int = 20) -> DataFrame:
    """Places where all anchor terms of a window lie within ``slop`` words of the rarest: doc, item_id, wid, pos.

    Positions are cut into cells of ``slop`` words; the rarest term's postings
    look into their own cell and both next ones, so distant postings make no pairs.
    """
    postings = index.filter("term IS NOT NULL").select("doc", "term", "pos")
    terms = anchors.groupBy("wid").agg(F.count("*").alias("_terms"))
    cell = F.floor(F.col("pos") / slop)
    lists = _on_terms(postings, anchors.select("wid", "rank", "term").join(terms, "wid"))
    rarest = lists.filter("rank = 1").select("doc", "wid", "pos", "_terms", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    others = lists.filter("rank > 1").select("doc", "wid", F.col("rank").alias("other"), F.col("pos").alias("near"), cell.alias("cell"))
    close = rarest.join(others, ["doc", "wid", "cell"], "left")
    within = F.when(F.abs(F.col("near") - F.col("pos")) <= slop, F.col("other"))
    met = close.groupBy("doc", "wid", "pos", "_terms").agg(F.count_distinct(within).alias("_met"))
    return met.filter("_met = _terms - 1").join(windows.select("wid", "item_id"), "wid").select("doc", "item_id", "wid", "pos")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Hit words and items of every document.

    ``docs``: doc_id, text; ``items``: item_id, text.  Returns, per row of ``docs``:
    doc (doc_id and a hash of the text), n_words, n_hit, n_items, items_sha256,
    contaminated.  Rows with equal doc_id and text are one document here and come
    out once.  Null and empty texts have no words; null item_ids and items
    without words have no windows.
    """
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc"), "text")
    windows = stage(test_windows(items.filter("item_id IS NOT NULL"), window), "windows")
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    counts = stage(term_counts(keyed, vocabulary), "term-counts")
    anchors = stage(rarest_terms(windows, counts), "anchors")
    index = build_index(keyed, anchors.select("term").distinct(), window - 1)
    matches = stage(phrase_matches(index, windows, anchors), "matches")
    heads = index.filter("term IS NULL").select("doc", "n_words").distinct()
    found = heads.join(hit_words(matches), "doc", "left").join(hit_items(matches), "doc", "left")
    return found.select(
        "doc", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def hit_words(matches: DataFrame) -> DataFrame:
    """Words of each document that lie in a match: the length of the union of all matches."""
    longest = matches.groupBy("doc", "start").agg(F.max("length").alias("length"))
    earlier = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = longest.withColumn("_until", F.coalesce(F.max(end).over(earlier), F.lit(0)))
    fresh = F.greatest(end - F.greatest("start", "_until"), F.lit(0))
    return covered.groupBy("doc").agg(F.sum(fresh).alias("n_hit"))


def hit_items(matches: DataFrame) -> DataFrame:
    """Number and digest of the items met in each document; a document meets each item once at most."""
    names = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    return matches.groupBy("doc").agg(F.count_distinct("item_id").alias("n_items"),
                                      F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a hit word, with all their columns."""
    hit = contamination(docs, items).filter("contaminated").select(F.col("doc").alias("_key"))
    keyed = w.record(docs, _key=F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    return w.unrecord(keyed.join(hit, "_key", "left_anti"), docs.columns)

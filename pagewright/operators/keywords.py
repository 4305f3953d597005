"""Keywords per document: word frequency, corpus TF-IDF, word-cloud terms.

A text table here is (doc_id, ord, text): a document may come in any number of
parts, ``ord`` gives their order.  Parts are never put back together; words are
counted where they are and the counts are combined on the map side.  Documents
of one part are counted within their row, so their words are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import text as tx
from ..session import stage
from .joins import hot_keys, salted_lookup

MAX_BROADCAST_TERMS = 100_000


def ratio_4_digits(part: Column, whole: Column) -> Column:
    """part/whole to 4 digits, rounded as the binary value of the quotient demands.

    A quotient can look like a tie between two 4-digit values, k/20000 with odd
    k, and yet lie just beside it in binary.  The integer arithmetic below finds
    the side: the quotient is split into its first 26 bits and the rest, both
    exact, and compared with the tie in units of 2**-70.
    """
    x = part / whole
    k = (part * 20000 / whole).cast("bigint")
    tie = ((part * 20000) % whole == 0) & (k % 2 == 1)
    high = F.floor(x * 2.0**26)
    low = ((x - high / F.lit(2.0**26)) * 2.0**70).cast("bigint")
    side = F.try_multiply(high * 20000 - k * 2**26, F.lit(2**44)) + low * 20000
    below = (k - 1) / 2
    up = (side > 0) | ((side == 0) & (below % 2 == 1))
    return F.when(tie, (below + F.when(up, 1).otherwise(0)) / 10000.0).otherwise(F.bround(x, 4))


def _position(texts: DataFrame, pos: str) -> Column:
    """(ord, ``pos``) as one sortable number, so that counting stays a hash aggregate.

    A struct would force sorting.  32-bit ordinals fit a long, wider ones a decimal.
    """
    narrow = texts.schema["ord"].dataType in (T.IntegerType(), T.ShortType(), T.ByteType())
    scale = F.col("ord").cast("bigint" if narrow else "decimal(20,0)") * F.lit(1 << 31)
    return scale + F.col(pos)


def _by_parts(texts: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Documents that are one row, and the rows of all others; None for a side without rows.

    A job reads the ids.  Where both kinds occur, the ids of those in parts are
    stored, so that Spark knows the size of the list before it plans the joins;
    where most are in parts, all are treated as such and nothing is joined.
    """
    rows = texts.groupBy("doc_id").agg(F.count("*").alias("rows"))
    lone, several = rows.agg(F.count_if(F.expr("rows = 1")), F.count_if(F.expr("rows > 1"))).first()
    if not several:
        return texts, None
    if lone <= several:
        return None, texts
    ids = stage(rows.filter("rows > 1").select(F.col("doc_id").alias("_id")), "in-parts")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    return texts.join(ids, same, "left_anti"), texts.join(ids, same, "left_semi")


def _counted(terms: Column) -> Column:
    """(word, n, first) of the terms of one text: in a sorted array equal words stand together, the earliest in front."""
    kept = F.filter(F.transform(terms, F.lower), lambda w: ~tx.is_stop_word(w))
    placed = F.sort_array(F.transform(kept, lambda w, i: F.struct(w.alias("word"), i.alias("first"))))

    def runs(found: Column) -> Column:
        def opening(t: Column, i: Column) -> Column:
            return F.when(~t["word"].eqNullSafe(F.get(found, i - 1)["word"]), i)

        def run(opens: Column, at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(opens, k + 1), F.size(found)) - at
            first = F.get(found, at)
            return F.struct(first["word"].alias("word"), n.cast("bigint").alias("n"), first["first"].alias("first"))

        opens = F.filter(F.transform(found, opening), F.isnotnull)
        return tx.bind(opens, lambda o: F.transform(o, lambda at, k: run(o, at, k)))

    return tx.bind(placed, runs)


def _counted_by_parts(texts: DataFrame, terms: Callable[[Column], Column]) -> DataFrame:
    """Case and stop words are seen to after the terms are rows, in compiled code."""
    found = texts.select("doc_id", "ord", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    found = found.withColumn("word", F.lower("term")).filter(~tx.is_stop_word(F.col("word")))
    return found.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min(_position(texts, "pos")).alias("first"))


def term_counts(texts: DataFrame, terms: Callable[[Column], Column] = tx.raw_words) -> DataFrame:
    """(doc_id, word, n, first): count and first position of every term; reads the ids first, see ``_by_parts``."""
    whole, parts = _by_parts(texts)
    found = []
    if whole is not None:
        rows = whole.select("doc_id", "ord", F.inline(_counted(terms(F.col("text")))))
        found.append(rows.select("doc_id", "word", "n", _position(texts, "first").alias("first")))
    if parts is not None:
        found.append(_counted_by_parts(parts, terms))
    return reduce(DataFrame.unionByName, found)


def _top(df: DataFrame, order: list[Column], top_k: int) -> DataFrame:
    # Spark limits each map task to top_k rows per document before the shuffle.
    best = Window.partitionBy("doc_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)


def most_frequent(counts: DataFrame, top_k: int) -> DataFrame:
    """Top terms by count; equal counts keep the order of first occurrence."""
    top = _top(counts, [F.desc("n"), F.asc("first")], top_k)
    top = top.withColumn("most", F.max("n").over(Window.partitionBy("doc_id")))  # at most top_k rows each
    return top.select("doc_id", "rank", "word", ratio_4_digits(F.col("n"), F.col("most")).alias("weight"))


def _most_frequent_in_row(texts: DataFrame, top_k: int, terms: Callable[[Column], Column]) -> DataFrame:
    """``most_frequent`` for documents of one row each, without a shuffle."""
    def ranked(counts: Column) -> Column:
        order = F.transform(counts, lambda c: F.struct((-c["n"]).alias("less"), c["first"].alias("first"), c["word"].alias("word")))
        return F.slice(F.sort_array(order), 1, top_k)

    def listed(top: Column) -> Column:
        most = -F.get(top, F.lit(0))["less"]
        return F.transform(top, lambda t, i: F.struct((i + 1).alias("rank"), t["word"].alias("word"), (-t["less"]).alias("n"), most.alias("most")))

    top = texts.select("doc_id", F.inline(tx.bind(tx.bind(_counted(terms(F.col("text"))), ranked), listed)))
    return top.select("doc_id", "rank", "word", ratio_4_digits(F.col("n"), F.col("most")).alias("weight"))


def frequency_keywords(texts: DataFrame, top_k: int = fv.TOP_KEYWORDS,
                       terms: Callable[[Column], Column] = tx.raw_words) -> DataFrame:
    """(doc_id, rank, word, weight) by word frequency; reads the ids first, see ``_by_parts``."""
    whole, parts = _by_parts(texts)
    found = []
    if whole is not None:
        found.append(_most_frequent_in_row(whole, top_k, terms))
    if parts is not None:
        found.append(most_frequent(_counted_by_parts(parts, terms), top_k))
    return reduce(DataFrame.unionByName, found)


def with_idf(counts: DataFrame) -> DataFrame:
    """Add ``idf`` = ln((N+1)/(df+1)) to term counts.

    Frequent terms would all meet in a few tasks of a plain join.  Those above
    1/MAX_BROADCAST_TERMS of all rows are fewer than that: they are broadcast,
    and their rows, most of the table, are not shuffled at all.  Each other term
    is a small group, joined by shuffle.

    ``counts`` is read several times and should be a stored table.
    """
    frequency = counts.groupBy("word").agg(F.count("*").alias("df"))
    documents = counts.agg(F.count_distinct("doc_id").alias("N"))
    rows = counts.agg(F.count("*").alias("total"))
    hot = F.broadcast(hot_keys(frequency, "df", rows, MAX_BROADCAST_TERMS))
    served = counts.join(hot, "word")
    rare = counts.join(hot.select("word"), "word", "left_anti").join(frequency, "word")
    idf = F.ln((documents.scalar() + 1) / (F.col("df") + 1))
    return served.unionByName(rare).withColumn("idf", idf).drop("df")


def most_specific(counts: DataFrame, top_k: int) -> DataFrame:
    """Top terms by term frequency times corpus idf; ``counts`` is a stored table.

    Within a document the term total is constant, so it is not needed for the
    ranking and only joined to the top rows.
    """
    scored = with_idf(counts).withColumn("score", F.round(F.col("n") * F.col("idf"), 8))
    top = _top(scored, [F.desc("score"), F.asc("word")], top_k)
    totals = counts.groupBy("doc_id").agg(F.sum("n").alias("total"))
    weight = F.bround(F.col("n") / F.col("total") * F.col("idf"), 4)
    return top.join(totals, "doc_id").select("doc_id", "rank", "word", weight.alias("weight"))


def tfidf_keywords(texts: DataFrame, top_k: int = fv.TOP_KEYWORDS,
                   terms: Callable[[Column], Column] = tx.raw_words) -> DataFrame:
    """(doc_id, rank, word, weight) by TF-IDF."""
    return most_specific(stage(term_counts(texts, terms).drop("first"), "terms"), top_k)


def extract_keywords(texts: DataFrame, languages: DataFrame, top_k: int = fv.TOP_KEYWORDS) -> DataFrame:
    """Chinese documents by TF-IDF of words and Han pairs, all others by word frequency.

    ``languages`` is (doc_id, language).  The texts are read once and never
    shuffled: both kinds of terms are counted for every document, and languages
    meet the counts, or for the common case only the few top rows of a document.
    """
    counts = stage(term_counts(texts, lambda t: F.concat(tx.raw_words(t), tx.han_bigrams(t))), "terms")
    zh = languages.filter("language = 'zh'").select("doc_id")
    plain = most_frequent(counts.filter(F.ascii("word") < 128), top_k).join(zh, "doc_id", "left_anti")
    chinese = stage(salted_lookup(counts.drop("first"), zh, "doc_id", F.col("word"), "left_semi"), "zh-terms")
    return plain.unionByName(most_specific(chinese, top_k))


def keyword_arrays(keywords: DataFrame) -> DataFrame:
    """(doc_id, keywords): the words in rank order; groups are capped by the top-k."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return keywords.groupBy("doc_id").agg(F.transform(rows, lambda r: r["word"]).alias("keywords"))


def wordcloud_terms(keywords: DataFrame) -> DataFrame:
    """Positive weights, the last duplicate of a word wins, sizes relative to the largest."""
    terms = (
        keywords.filter("weight > 0")
        .groupBy("doc_id", "word")
        .agg(F.max_by("weight", "rank").alias("weight"))
    )
    largest = F.max("weight").over(Window.partitionBy("doc_id"))
    return terms.withColumn("rel_size", F.col("weight") / largest)

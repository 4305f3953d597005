"""A deterministic stand-in for model summaries: the best sentences of a text.

It picks sentences, it does not write any; use it where no model is at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, sentences, words
from .joins import salted_lookup


def extractive_summary(texts: DataFrame, keywords: DataFrame, keep: int = 3) -> DataFrame:
    """(doc_id, index, summary): the ``keep`` sentences richest in keyword weight.

    A sentence scores the mean weight its words have among the document's
    keywords.  The keyword table of a document is capped by its top-k, so it
    travels as a small map and the rest is array work inside the row.  A null
    text has the summary of an empty one.
    """
    weights = keywords.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("weights")
    )
    rows = salted_lookup(texts, weights, "doc_id", F.col("index"))
    known = F.coalesce("weights", F.create_map().cast("map<string,double>"))

    def score(sentence: Column, at: Column) -> Column:
        def mean(found: Column) -> Column:
            total = F.aggregate(found, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(known, w), F.lit(0.0)))
            return F.coalesce(F.try_divide(total, F.size(found)), F.lit(0.0))

        return F.struct((-F.round(bind(words(sentence), mean), 6)).alias("cost"), at.alias("at"), sentence.alias("s"))

    best = F.slice(F.array_sort(F.transform(sentences(F.coalesce("original", F.lit(""))), score)), 1, keep)
    in_order = F.array_sort(F.transform(best, lambda b: F.struct(b["at"].alias("at"), b["s"].alias("s"))))
    return rows.select("doc_id", "index", F.array_join(F.transform(in_order, lambda b: b["s"]), " ").alias("summary"))

"""Greedy sentence windows inside one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import bind, sentences, strip


def windows(text: Column, limit: int = fv.WINDOW_CHARS) -> Column:
    """Sentences gathered up to ``limit`` characters, joined by a blank.

    The fold carries lengths and the positions at which windows open; texts are
    only sliced at the end.  A text without sentences is one window unless blank.
    """
    return bind(sentences(text), lambda s: _windows_of(s, text, limit))


def _windows_of(parts: Column, text: Column, limit: int) -> Column:
    start = F.struct(
        F.lit(1 << 30).cast("bigint").alias("buf"), F.lit(1).alias("at"),
        F.array().cast("array<int>").alias("opens"),
    )

    def scan(s: Column, sentence: Column) -> Column:
        size = F.length(sentence)
        opens = s["buf"] + size + 1 > limit
        return F.struct(
            F.when(opens, size.cast("bigint")).otherwise(s["buf"] + size + 1).alias("buf"),
            (s["at"] + 1).alias("at"),
            F.when(opens, F.array_append(s["opens"], s["at"])).otherwise(s["opens"]).alias("opens"),
        )

    def cut(s: Column) -> Column:
        def window(at: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(s["opens"], i + 1), F.size(parts) + 1)
            return F.array_join(F.slice(parts, at, stop - at), " ")

        return F.transform(s["opens"], window)

    packed = F.aggregate(parts, start, scan, cut)
    whole_text = F.when(strip(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 0, packed).otherwise(whole_text)

"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns that are computed exactly once.

    A filter on an ordinary projected column is pushed below the projection and
    the expression runs twice.  Regex work over whole texts is too dear for
    that, so the values come out of a generator, which filters do not cross.
    """
    bound = F.struct(*[c.alias(n) for n, c in named.items()])
    return df.select("*", F.inline(F.array(bound)))


def ordered_text(order: Column, text: Column, sep: str) -> Column:
    """Aggregate: the texts of a *bounded* group, joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("at"), text.alias("text"))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), sep)

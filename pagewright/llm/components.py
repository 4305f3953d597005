"""Connected components of a stored edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of ``edges`` (a, b); label is the smallest id reachable.

    Each turn links every node's larger neighbours, then its smaller ones, to the
    smallest neighbour.  The edges end as stars around the smallest ids, after a
    number of turns that grows with the logarithm of the nodes.  Every turn is
    written to the shared folder; the driver sees a count and a checksum.  Nodes
    with very many neighbours only meet one-row partners in the joins, which
    adaptive execution splits.
    """
    a, b = F.col("a"), F.col("b")
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = _checksum(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(pairs.select("e.*").filter("u <> v").distinct(), "edges")
        after = _checksum(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

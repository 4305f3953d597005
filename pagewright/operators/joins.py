"""Joins that keep their balance when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT = 10_000


def hot_keys(counts: DataFrame, n: str, total: DataFrame, max_hot: int = MAX_HOT) -> DataFrame:
    """Rows of ``counts`` whose ``n`` is more than 1/max_hot of the total.

    ``total`` is the sum of all ``n`` as a one-row table.  Fewer than ``max_hot``
    keys can pass, whatever the data, so the result is always safe to broadcast,
    and every key left out is small.
    """
    return counts.filter(F.col(n) * max_hot > total.scalar())


def salted_lookup(facts: DataFrame, dim: DataFrame, key: str, spread: Column, how: str = "left",
                  max_hot: int = MAX_HOT) -> DataFrame:
    """Equi-join of ``facts`` with ``dim`` on ``key``; only hot keys are salted.

    A hot key, one with more than 1/max_hot of the rows, is cut into as many
    buckets as its share needs for no bucket to exceed 1/max_hot.  Its rows are
    dealt out by ``spread`` (any value that varies within the key) and the
    matching rows of ``dim`` are repeated once per bucket, fewer than 2*max_hot
    copies in all if ``dim`` is unique.  Both sides learn the hot keys from a
    broadcast of fewer than ``max_hot`` rows.  Works for inner, left, left_semi
    and left_anti.

    ``facts`` is read twice, the first time for ``key`` alone: keys that are dear
    to compute should come from a stored table.
    """
    counts = facts.groupBy(key).agg(F.count("*").alias("_n"))
    total = facts.agg(F.count("*").alias("total"))
    buckets = F.ceil(F.col("_n") * max_hot / total.scalar()).cast("int")
    hot = F.broadcast(hot_keys(counts, "_n", total, max_hot).select(key, buckets.alias("_buckets")))
    bucket = F.pmod(F.xxhash64(spread), F.col("_buckets")).cast("int")
    left = facts.join(hot, key, "left").withColumn("_salt", F.coalesce(bucket, F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_buckets"), F.lit(1)) - 1)
    right = dim.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_buckets")
    return left.drop("_buckets").join(right, [key, "_salt"], how).drop("_salt")

"""Sharding by sampled splitters: near-equal bytes, contiguous key ranges.

Keys are sampled with a chance in proportion to their rows' sizes, quantiles of
the sample cut the key space into many ranges, exact sums per range are taken
over all rows, ranges that came out overfull are subdivided, and the ranges in
order are laid over the shards.  The driver sees the sample and the sums, both
bounded by parameters; rows are only ever dealt out by range.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as w

RANGES = 1024
SAMPLES_PER_RANGE = 16
LOWEST = -(2**63)


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text plus one; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


@dataclass(frozen=True)
class Splitters:
    """Sorted lower bounds (key, tie) of all ranges but the first."""

    keys: np.ndarray
    ties: np.ndarray

    def range_of(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.keys, key, side) for side in ("left", "right"))
        out = low.copy()
        met = np.flatnonzero(high > low)
        for at in np.unique(low[met]):
            rows = met[low[met] == at]
            out[rows] += np.searchsorted(self.ties[at : high[rows[0]]], tie[rows], "right")
        return out.astype(np.int32)


def sample_splitters(keyed: DataFrame, total: int, ranges: int = RANGES, seed: int = 17) -> Splitters:
    """Quantiles of a size-weighted sample of ``keyed`` (_key, _tie, _size).

    A row is drawn with the chance size * draws / total, by a hash of its keys, so
    the sample holds 16 rows a range on average, whatever the input.  A key met by
    two bounds or more is heavy and cut at the ties; else the bound is moved to
    the start of its key, so that rows of one key stay together.
    """
    draws = ranges * SAMPLES_PER_RANGE
    chance = F.col("_size") * (draws / max(total, 1))
    draw = F.pmod(F.xxhash64("_key", "_tie", F.lit(seed)), F.lit(2**53)) / float(2**53)
    rows = keyed.filter(draw < chance).select("_key", "_tie", F.greatest("_size", F.lit(total / draws)).alias("weight")).toPandas()
    rows = rows.sort_values(["_key", "_tie"], ignore_index=True)
    gone = rows["weight"].cumsum().to_numpy()
    if not len(rows):
        return Splitters(np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = np.searchsorted(gone, np.arange(1, ranges) * gone[-1] / ranges)
    bounds = rows.iloc[at][["_key", "_tie"]].drop_duplicates(ignore_index=True)
    heavy = bounds.groupby("_key")["_tie"].transform("size") > 1
    bounds.loc[~heavy, "_tie"] = LOWEST
    return Splitters(bounds["_key"].to_numpy(np.int64), bounds["_tie"].to_numpy(np.int64))


def shard(rows: DataFrame, key: Column, tie: Column, size: Column, n_shards: int = 8, ranges: int = RANGES) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within a shard).

    Rows are ordered by the hash of ``key``, then of ``tie``; equal keys meet in
    one range unless they overfill it.  Null keys and ties count as values.  A
    row can't be split, so shards differ by a row's size besides the width of a
    range, 1/ranges of all bytes.  Equal rows may swap their slots, which no one
    can tell.  An empty table gives an empty one.  Columns that ``rows`` carries
    pass through; columns called shard or slot are replaced.
    """
    keyed = w.record(rows, _key=F.xxhash64(key, F.lit(1)), _tie=F.xxhash64(tie, F.lit(2)), _size=size.cast("long"))
    slim = keyed.select("_key", "_tie", "_size")
    total, n = slim.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    splitters = sample_splitters(slim, total, ranges)

    @F.pandas_udf("int")
    def range_of(k: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(splitters.range_of(k.to_numpy(), t.to_numpy()))

    in_range = range_of("_key", "_tie").alias("_range")
    sums = slim.select("_size", in_range).groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).toPandas()
    full = np.maximum(sums["bytes"] * ranges / max(total, 1), sums["n"] * ranges / max(n, 1))
    parts = np.where(full > 2, np.ceil(full), 1).astype(np.int32)
    by_range = np.ones(ranges + 1, np.int32)
    by_range[sums["_range"].to_numpy(int)] = parts
    part = F.pmod(F.xxhash64("_tie", F.lit(3)), F.element_at(F.lit(by_range.tolist()), F.col("_range") + 1)).cast("int")
    sizes = slim.select("_size", "_tie", in_range).select("_size", "_range", part.alias("_part"))
    cells = sizes.groupBy("_range", "_part").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).toPandas()
    placed = rows.sparkSession.createDataFrame(_layout(cells, total, n_shards), "_range int, _part int, shard int, _before long")
    dealt = keyed.select("*", in_range).withColumn("_part", part).join(F.broadcast(placed), ["_range", "_part"])
    order = Window.partitionBy("_range", "_part").orderBy("_key", "_tie")
    slot = F.col("_before") + F.row_number().over(order) - 1
    return w.unrecord(dealt.withColumn("slot", slot), rows.columns, "shard", "slot")


def _layout(cells: pd.DataFrame, total: int, n_shards: int) -> pd.DataFrame:
    """The shard of each cell, by the middle of its bytes, and the rows before it there."""
    cells = cells.sort_values(["_range", "_part"], ignore_index=True)
    middle = cells["bytes"].cumsum() - cells["bytes"] / 2
    cells["shard"] = np.minimum(n_shards - 1, middle * n_shards // max(total, 1)).astype(np.int32)
    cells["_before"] = cells.groupby("shard")["n"].cumsum() - cells["n"]
    return cells[["_range", "_part", "shard", "_before"]].astype({"_range": "int32", "_part": "int32", "_before": "int64"})

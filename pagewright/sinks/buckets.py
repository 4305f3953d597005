"""Tables in buckets of their key: a write touches the buckets of its keys and leaves the others as they are.

Data lie in folders by version and bucket; the manifest says which folders count.
Its rows for a write are one file, appended after the data are whole, so a write
that dies leaves the table as it was, and one that is repeated under its version
replaces itself.  A table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

MANIFEST = "version long, bucket int, base boolean, n long"


@dataclass(frozen=True)
class BucketTable:
    """``schema`` is a DDL string that holds ``key``.  The number of buckets is fixed at the first write; it bounds
    what the driver sees of a table, so choose it for buckets of a few hundred megabytes."""

    path: str
    key: str
    schema: str
    buckets: int = 1024

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")


def touched(table: BucketTable, changes: DataFrame) -> set[int]:
    """The buckets of the keys of ``changes``: at most ``table.buckets`` numbers."""
    return {r[0] for r in changes.select(table.bucket()).distinct().collect()}


def rows(spark: SparkSession, table: BucketTable, only: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
    """The rows of the buckets ``only`` (null: of all), as the versions ``before`` one left them (null: all versions).

    A table that was never written is empty.
    """
    live = _live(spark, table, before)
    wanted = None if only is None else set(only)
    folders = [_folder(table, r.version, r.base) + f"/_bucket={r.bucket}" for r in live if r.n and (wanted is None or r.bucket in wanted)]
    reader = spark.read.schema(table.schema)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], table.schema)


def rewrite(table: BucketTable, changes: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> None:
    """Replace the buckets that ``changes`` touch by ``fold(their rows, changes)``, which must keep keys in their buckets."""
    spark = changes.sparkSession
    held = stage(changes, "changes")
    numbers = touched(table, held)
    if numbers:
        _put(table, fold(rows(spark, table, numbers, version), held), version, numbers)


def add(table: BucketTable, new: DataFrame, version: int) -> None:
    """Append rows beside those of their buckets, which are not read."""
    _put(table, new, version, None)


def merge(spark: SparkSession, table: BucketTable, version: int, parts: int = 16) -> None:
    """Put the buckets of more than ``parts`` folders together in one folder each, after all of ``version`` is written."""
    folders: dict[int, int] = {}
    for r in _live(spark, table, version + 1):
        folders[r.bucket] = folders.get(r.bucket, 0) + 1
    many = {b for b, n in folders.items() if n > parts}
    if many:
        _put(table, rows(spark, table, many, version + 1), version, many)


def _folder(table: BucketTable, version: int, base: bool) -> str:
    return f"{table.path.rstrip('/')}/{'whole' if base else 'added'}={version}"


def _live(spark: SparkSession, table: BucketTable, before: int | None) -> list:
    """Manifest rows that count: of every bucket the last whole folder and what was added after it."""
    try:
        noted = spark.read.schema(MANIFEST).parquet(f"{table.path.rstrip('/')}/manifest")
    except AnalysisException:  # no write was ended yet
        return []
    if before is not None:
        noted = noted.filter(F.col("version") < before)
    bases = noted.filter("base").groupBy("bucket").agg(F.max("version").alias("since"))
    since = F.coalesce("since", F.lit(-1))
    counts = F.when(F.col("base"), F.col("version") == since).otherwise(F.col("version") > since)
    return noted.join(bases, "bucket", "left").filter(counts).select("version", "bucket", "base", "n").distinct().collect()


def _put(table: BucketTable, df: DataFrame, version: int, whole: set[int] | None) -> None:
    """Write one folder per bucket, then note them; a bucket of ``whole`` that is left without rows is noted as empty."""
    spark, base = df.sparkSession, whole is not None
    names = spark.createDataFrame([], table.schema).columns
    folder = _folder(table, version, base)
    df.select(*names, table.bucket().alias("_bucket")).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
    try:
        written = spark.read.parquet(folder).groupBy("_bucket").agg(F.count("*").alias("n")).collect()
    except AnalysisException:  # no row, no file, no schema to read
        written = []
    found = dict.fromkeys(whole or (), 0) | {r[0]: r.n for r in written}
    if found:
        noted = [(version, b, base, n) for b, n in sorted(found.items())]
        spark.createDataFrame(noted, MANIFEST).coalesce(1).write.mode("append").parquet(f"{table.path.rstrip('/')}/manifest")

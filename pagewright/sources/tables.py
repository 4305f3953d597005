"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose rows occupy all cores.

    A file with a single row group is read by one task, whatever its number of
    splits.  Tables with fewer splits than cores are therefore dealt out again;
    larger ones, where it would only cost a shuffle, are left as they are.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

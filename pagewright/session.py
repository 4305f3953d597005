"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the plans count on; sizes of partitions are left to AQE."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names.

    Only a session on this one machine may leave the setting out; it then gets a
    temporary folder.  On a cluster every executor would see its own disk there,
    so the missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several later steps read, and go on from the files.

    Dear work is then done once, and a lost executor costs a read, not a rerun.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

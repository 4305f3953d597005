"""Event logs in NDJSON: files, or a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines, strip
from ..schemas import EVENT


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One event per line; blank lines are skipped by the reader."""
    return spark.read.schema(EVENT).json(path)


def parse_events(buffers: DataFrame, column: str = "buffer") -> DataFrame:
    """Events out of a text column: cut at line breaks, trim, skip blanks, parse."""
    cut = F.filter(F.transform(lines(F.col(column)), strip), lambda s: s != "")
    return buffers.select(F.explode(cut).alias("_line")).select(F.inline(F.array(F.from_json("_line", EVENT))))

"""Writers.  All of them can be repeated after a lost executor or a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import state
from .buckets import BucketTable, rewrite


def write_events(events: DataFrame, path: str) -> None:
    """NDJSON with explicit nulls, text as it is."""
    row = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"})
    events.select(row.alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_uploads(uploads: DataFrame, first: DataFrame, path: str, order: str) -> None:
    """Each distinct content once, in folders by the head of its digest.

    ``first`` names the copy to keep (see ``sources.uploads.first_copies``), so
    the contents of the other copies are dropped before they are shuffled.  A copy
    is named by ``order`` and digest together, since file names repeat; should the
    full name and the content repeat too, one of the rows is written.
    """
    kept = uploads.join(first.select(order, "digest"), [order, "digest"], "left_semi").dropDuplicates(["digest"])
    kept.withColumn("shard", F.left("digest", F.lit(2))).write.mode("overwrite").partitionBy("shard").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows as text, ordered by document and position across files."""
    order = ["doc_id", "section", "index", "ord"]
    # Ranges cut through long documents, so one document may fill several files.
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = (
        F.when(F.col("kind") == "title", "# ").when(F.col("kind") == "heading", "## ")
        .when(F.col("kind") == "segment", "### ").when(F.col("kind") == "tag", "#### ").otherwise("")
    )
    placed.select(F.concat(mark, F.col("text")).alias("value")).write.mode("overwrite").text(path)


def upsert_cache(cache: BucketTable, writes: DataFrame, version: int, *order: str) -> None:
    """``state.cache_upsert`` on a stored cache: only the buckets of the written keys are rewritten."""
    rewrite(cache, writes, lambda old, new: state.cache_upsert(old, new, *order), version)


def delete_history(history: BucketTable, tombstones: DataFrame, version: int) -> None:
    """``state.history_delete`` on a stored history, in the buckets of the deleted ids."""
    rewrite(history, tombstones.select("doc_id").distinct(), state.history_delete, version)

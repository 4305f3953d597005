"""New files as a stream, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import stage
from ..sinks.buckets import BucketTable, add, merge, rows, touched
from ..sources.uploads import first_copies, with_digest, with_filename


def upload_stream(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)
    )
    return with_digest(with_filename(files))


def store_uploads(uploads: DataFrame, out: str, checkpoint: str, order: str = "filename", buckets: int = 1024,
                  merge_every: int = 64) -> StreamingQuery:
    """Store every distinct content once.

    Copies inside a batch are found by their digests alone, so the copies of one
    popular file do not travel.  Digests of earlier batches are looked up in a
    table of their own beside ``out``, in the buckets that the batch's digests fall
    into; stored contents are not read again.  A repeated batch sees the digests as
    they were before it and overwrites its own folder.
    """
    index = digest_table(out, buckets)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = stage(first_copies(batch, order).select(order, "digest"), "first-copies")
        known = rows(spark, index, touched(index, first), before=batch_id)
        fresh = stage(first.join(known, "digest", "left_anti"), "new-copies")
        kept = batch.join(fresh, [order, "digest"], "left_semi").dropDuplicates(["digest"])
        kept.write.mode("overwrite").parquet(f"{out}/part={batch_id}")
        add(index, fresh, batch_id)
        if (batch_id + 1) % merge_every == 0:
            merge(spark, index, batch_id)

    writer = uploads.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def digest_table(out: str, buckets: int = 1024) -> BucketTable:
    """The digests stored below ``out``."""
    return BucketTable(out.rstrip("/") + "-digests", "digest", "digest string", buckets)

"""Job state, cache and history kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import fold_jobs, latest
from ..schemas import EVENT


def event_stream(spark: SparkSession, path: str, schema: T.StructType = EVENT, fmt: str = "json",
                 pattern: str = "*") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern).load(path)


def stream_jobs(events: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep job states; every batch appends the changed rows below ``out``.

    The folder of a batch is overwritten when the batch is repeated, so the
    output stays exact across restarts.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    writer = fold_jobs(events).writeStream.outputMode("update").foreachBatch(save)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_jobs(spark: SparkSession, out: str) -> DataFrame:
    """Current state: the last saved row of every job."""
    saved = spark.read.parquet(out).drop("part")
    return latest(saved, "doc_id", "batch").drop("batch")


def stream_outcomes(events: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Side effects of finished documents: cache and history writes, failures to history only.

    ``events`` carries ``key`` (the cache key) beside the event columns.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        ended = batch.filter("type in ('result', 'error')").persist()
        good = ended.filter("type = 'result' and data is not null")
        good.select("key", F.col("data").alias("result"), "seq").write.mode("overwrite").parquet(
            f"{out}/cache/part={batch_id}")
        op = F.when(F.col("type") == "error", "fail").otherwise("finish")
        ended.filter("type = 'error' or data is not null").select(
            "doc_id", "seq", op.alias("op"),
            F.when(F.col("type") == "result", F.col("data")).alias("result"),
            F.when(F.col("type") == "error", F.col("message")).alias("error"),
        ).write.mode("overwrite").parquet(f"{out}/history/part={batch_id}")
        ended.unpersist()

    writer = events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def throughput(events: DataFrame, ts: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Our addition: finished documents per time window, batch or stream."""
    done = events.filter("type in ('result', 'error')").withWatermark(ts, late)
    return done.groupBy(F.window(ts, width), "type").agg(F.count("*").alias("n"))

"""Replies kept by request: a model is asked a question once, over all documents and runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REPLIES
from ..session import scratch_dir, stage
from .inference import Client, run_inference
from .joins import salted_lookup
from .state import latest

CALLS_PER_TASK = 256
CALLS_AT_ONCE = 1_000_000


def ask_key(model: str = "") -> Column:
    """What a reply depends on: model, kind, messages, temperature and budget, as one digest."""
    asked = F.to_json(F.struct("kind", "messages", "temperature", "max_tokens"), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(f"{model}\n"), asked), 256)


def open_replies(spark: SparkSession, store: str) -> DataFrame:
    """The reply table below ``store``, made if it is new: one folder per wave of calls."""
    try:
        return spark.read.schema(REPLIES).parquet(store)
    except AnalysisException:  # no such folder yet
        spark.createDataFrame([], REPLIES).write.parquet(f"{store}/wave=0")
        return spark.read.schema(REPLIES).parquet(store)


def replies(spark: SparkSession, store: str) -> DataFrame:
    """The last good reply of every request that has one."""
    good = open_replies(spark, store).filter("error IS NULL")
    return latest(good, "ask", "at")


def compact_replies(spark: SparkSession, store: str, target: str, files: int) -> None:
    """The good replies of many waves as a new store of a few files; the old one stays as it is."""
    replies(spark, store).repartition(files, "ask").select(*REPLIES.names).write.parquet(f"{target}/wave=0")


def ask_once(requests: DataFrame, client_factory: Callable[[], Client], store: str, model: str = "",
             calls_per_task: int = CALLS_PER_TASK, calls_at_once: int = CALLS_AT_ONCE) -> DataFrame:
    """``run_inference`` for what ``store`` has no reply to; its responses, and ``hit`` (no call was made for the row).

    Equal requests of many documents are one call.  Calls are made in waves of
    ``calls_at_once``, a task making ``calls_per_task`` of them; the replies of a
    wave become visible together when its job commits.  So a lost task repeats its
    own calls, a lost driver those of one wave, and what is in the store is never
    asked again.  Failing calls are returned and recorded, but the next run asks
    them anew.  One run at a time should write to a store; two would ask twice.
    """
    spark = requests.sparkSession
    asked = stage(requests.withColumns({"ask": ask_key(model), "_n": F.monotonically_increasing_id()}), "asked")
    known = replies(spark, store).select("ask")
    firsts = asked.groupBy("ask").agg(F.min("_n").alias("_n")).join(known, "ask", "left_anti")
    todo = stage(firsts, "to-ask")
    n = todo.count()
    if n:
        _call(asked, todo, n, client_factory, store, calls_per_task, calls_at_once)
    # This run's failures are answers too, unless the store has a good one.
    kept = spark.read.schema(REPLIES).parquet(store)
    rank = F.struct(F.col("error").isNull().alias("good"), "at")
    answers = latest(kept.withColumn("_rank", rank), "ask", "_rank").select("ask", "text", "elapsed", "completion_tokens", "error")
    joined = salted_lookup(asked, answers, "ask", F.col("_n"), "inner")
    called = joined.join(todo.select("_n", F.lit(False).alias("_asked")), "_n", "left")
    return called.select("doc_id", "index", "win_idx", "kind", "text", "elapsed", "completion_tokens", "error",
                         F.coalesce("_asked", F.lit(True)).alias("hit"))


def _call(asked: DataFrame, todo: DataFrame, n: int, client_factory: Callable[[], Client], store: str, calls_per_task: int, calls_at_once: int) -> None:
    spark = asked.sparkSession
    waves = -(-n // calls_at_once)
    wave = F.pmod(F.xxhash64("ask", F.lit(1)), F.lit(waves)).alias("wave")
    path = scratch_dir(spark, "calls")
    # Numbers in a run are unique, so a hot request is no hot key here.
    asked.join(todo.select("_n"), "_n", "left_semi").withColumn("wave", wave).write.partitionBy("wave").parquet(path)
    for k in range(waves):
        part = spark.read.parquet(path).filter(F.col("wave") == k).withColumn("doc_id", F.col("ask"))
        said = run_inference(part, client_factory, tasks=-(-n // waves // calls_per_task) or 1)
        rows = said.select(F.col("doc_id").alias("ask"), "kind", "text", "elapsed", "completion_tokens", "error", F.current_timestamp().alias("at"))
        rows.write.parquet(f"{store}/wave={uuid.uuid4().hex}")

"""Run requests against a caller's model and put the replies together."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.replies import strip_think
from ..functions.text import sentences
from ..schemas import RESPONSES
from .frames import ordered_text

CALLS_AT_ONCE = 256  # replies held in a task before they are handed on

# A client takes (system, user, max_tokens, temperature) and returns
# (text, completion_tokens).
Client = Callable[[str, str, int, float], tuple[str, int]]

# A batch translator takes (sentences, source language code) and returns as many
# translations; the target language is the factory's business.
BatchTranslator = Callable[[list[str], str], list[str]]
BATCH_SIZE = 16


def _responses_schema(requests: DataFrame) -> T.StructType:
    """RESPONSES, with document ids of the type the requests use."""
    ids = requests.schema["doc_id"].dataType
    return T.StructType([T.StructField(f.name, ids if f.name == "doc_id" else f.dataType) for f in RESPONSES])


def _dealt_out(requests: DataFrame, tasks: int | None) -> DataFrame:
    """Requests spread evenly, so that one long document lands on many tasks.

    The number is always explicit: adaptive execution would otherwise judge by
    bytes, and put thousands of slow calls into one task.
    """
    spark = requests.sparkSession
    if tasks is None:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return requests.repartition(tasks, "doc_id", "kind", "index", "win_idx")


def _flat(requests: DataFrame, *more: str) -> DataFrame:
    """What a worker needs of a request: a column each for the two messages, since nested rows are dear to turn into Python's."""
    says = [F.col("messages")[i]["content"].alias(n) for i, n in enumerate(("system", "user"))]
    places = [F.col(c).cast("bigint").alias(c) for c in ("index", "win_idx")]
    return requests.select("doc_id", *places, "kind", *says, *more)


def run_inference(requests: DataFrame, client_factory: Callable[[], Client],
                  tasks: int | None = None) -> DataFrame:
    """Requests in, responses out; a failing call is recorded, not raised.

    The factory runs once per task.  A lost task repeats its calls, so very large
    batches should be cut into many ``tasks``.
    """

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()

        def call(row: Any) -> tuple[str | None, float, int, str | None]:
            started = time.perf_counter()
            try:
                text, tokens = client(row.system, row.user, int(row.max_tokens), float(row.temperature))
                return text, time.perf_counter() - started, int(tokens or 0), None
            except Exception as problem:
                return None, time.perf_counter() - started, 0, str(problem) or type(problem).__name__

        for batch in (frame.iloc[at:at + CALLS_AT_ONCE] for frame in batches for at in range(0, len(frame), CALLS_AT_ONCE)):
            out = [call(row) for row in batch.itertuples(index=False)]
            yield batch[["doc_id", "index", "win_idx", "kind"]].assign(
                text=[o[0] for o in out], elapsed=[o[1] for o in out],
                completion_tokens=[o[2] for o in out], error=[o[3] for o in out],
            )

    replies = _dealt_out(_flat(requests, "max_tokens", "temperature"), tasks).mapInPandas(calls, _responses_schema(requests))
    return replies.withColumn("text", strip_think(F.col("text")))


def run_batches(requests: DataFrame, factory: Callable[[], BatchTranslator], batch_size: int = BATCH_SIZE,
                tasks: int | None = None) -> DataFrame:
    """``sentence_requests`` through a translator that takes lists of sentences of one language."""

    def calls(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translate = factory()
        for frame in frames:
            users, places = frame.column("user").to_pylist(), {}
            for at, source in enumerate(frame.column("system").to_pylist()):
                places.setdefault(source, []).append(at)
            texts, errors, each = [None] * len(users), [None] * len(users), [0.0] * len(users)
            for source, same in places.items():
                for low in range(0, len(same), batch_size):
                    batch = same[low:low + batch_size]
                    started = time.perf_counter()
                    try:
                        said = list(translate([users[at] for at in batch], source))
                        if len(said) != len(batch):
                            raise ValueError(f"{len(said)} translations for {len(batch)} sentences")
                        for at, text in zip(batch, said):
                            texts[at] = text
                    except Exception as problem:
                        for at in batch:
                            errors[at] = str(problem) or type(problem).__name__
                    took = (time.perf_counter() - started) / len(batch)
                    for at in batch:
                        each[at] = took
            yield pa.RecordBatch.from_arrays(
                [*(frame.column(c) for c in ("doc_id", "index", "win_idx", "kind")), pa.array(texts, pa.string()), pa.array(each, pa.float64()),
                 pa.array([0] * len(users), pa.int64()), pa.array(errors, pa.string())],
                ["doc_id", "index", "win_idx", "kind", "text", "elapsed", "completion_tokens", "error"])

    return _dealt_out(_flat(requests), tasks).mapInArrow(calls, _responses_schema(requests))


def merge_translations(responses: DataFrame, sep: str = "\n") -> DataFrame:
    """Replies of a chunk's windows back in order, with summed cost.

    ``sep`` is a line break for windows and a blank for single sentences.  The
    windows of one chunk are a bounded group.
    """
    return responses.filter("kind = 'translation'").groupBy("doc_id", "index").agg(
        ordered_text(F.col("win_idx"), F.coalesce("text", F.lit("")), sep).alias("text"),
        F.sum("elapsed").alias("elapsed"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.max("error").alias("error"),
    )


def with_sentence_count(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("n_sentences", F.size(sentences(F.col("original"))))

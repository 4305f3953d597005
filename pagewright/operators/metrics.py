"""The speed report of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import tokens_per_second


def speed_report(responses: DataFrame, run: str = "run_id") -> DataFrame:
    """Time, tokens and rates per run.

    ``responses`` has run_id, kind (summary, overview, translation, extract),
    elapsed, completion_tokens, n_sentences.  The mean summary time counts the
    overview call as one more segment.  Sums combine on the map side.
    """

    def total(column: str, *kinds: str):
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col(column))), F.lit(0))

    sums = responses.groupBy(run).agg(
        F.count_if(F.col("kind") == "summary").alias("n_segments"),
        total("elapsed", "extract").alias("extract_time"),
        total("elapsed", "summary", "overview").alias("summary_time"),
        total("completion_tokens", "summary", "overview").alias("summary_tokens"),
        total("elapsed", "translation").alias("translate_time"),
        total("completion_tokens", "translation").alias("translate_tokens"),
        total("n_sentences", "translation").alias("translate_sentences"),
    )
    n = F.col("n_segments")
    return sums.withColumns({
        "summary_tokens_per_sec": tokens_per_second(F.col("summary_tokens"), F.col("summary_time")),
        "summary_avg_time": F.when(n > 0, F.col("summary_time") / (n + 1)).otherwise(0.0),
        "translate_tokens_per_sec": tokens_per_second(F.col("translate_tokens"), F.col("translate_time")),
        "translate_sentences_per_sec": tokens_per_second(F.col("translate_sentences"), F.col("translate_time")),
        "total_time": F.col("extract_time") + F.col("summary_time") + F.col("translate_time"),
    })

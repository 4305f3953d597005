"""The progress events of an analysis, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv

STEPS_PER_BLOCK = 4096
_EVENT = "struct<type:string,progress:int,message:string>"


def segment_progress(done: Column, total: Column) -> Column:
    return fv.STEP_EXTRACTED + F.floor(fv.STEP_SEGMENT_SPAN * done / total).cast("int")


def _event(kind: str, progress: Column | int, message: Column) -> Column:
    value = F.lit(progress) if isinstance(progress, int) else progress
    return F.struct(F.lit(kind).alias("type"), value.cast("int").alias("progress"), message.alias("message"))


def _when(condition: Column, event: Column) -> Column:
    return F.when(condition, event)


def progress_events(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, type, progress, message) for every document.

    ``docs`` has doc_id, total_pages, n_chunks, language, skip_translation,
    do_summary, do_wordcloud, do_report, and for failed documents ``error`` with
    ``failed_after``: finished segments, -1 = failed while reading; with all
    segments finished it was the overview that failed.

    Events per segment follow from the counts alone, no text is read.  A document
    first becomes spans: single events, and blocks of up to STEPS_PER_BLOCK
    segment events.  The spans are spread over the cluster before they are
    expanded, so one document may have any number of segments.
    """
    n = F.col("n_chunks").cast("bigint")
    failed = F.col("error").isNotNull()
    read = ~failed | (F.col("failed_after") >= 0)
    empty = read & (n == 0)
    skip = read & (n > 0) & F.col("skip_translation")
    going_on = ~failed & (n > 0)
    overview_failed = failed & (n > 0) & (F.col("failed_after") >= n)

    head = [
        _event("progress", fv.STEP_EXTRACT, F.lit(fv.MSG_EXTRACT)),
        _when(read, _event("progress", fv.STEP_EXTRACTED, F.format_string(fv.MSG_EXTRACTED, "total_pages", n))),
        _when(empty, _event("error", fv.STEP_END, F.lit(fv.MSG_NO_TEXT))),
        _when(skip, _event("progress", fv.STEP_SKIP_TRANSLATION, F.format_string(fv.MSG_SKIP_TRANSLATION, "language"))),
    ]
    tail = [
        _when((going_on | overview_failed) & F.col("do_summary"), _event("progress", fv.STEP_OVERVIEW, F.lit(fv.MSG_OVERVIEW))),
        _when(going_on & F.col("do_wordcloud"), _event("progress", fv.STEP_KEYWORDS, F.lit(fv.MSG_KEYWORDS))),
        _when(going_on & F.col("do_report"), _event("progress", fv.STEP_REPORT, F.lit(fv.MSG_REPORT))),
        _when(going_on, _event("result", fv.STEP_END, F.lit(fv.MSG_DONE))),
        _when(failed & ~empty, _event("error", fv.STEP_END, F.format_string(fv.MSG_FAILED, "error"))),
    ]
    finished = F.when(failed, F.greatest(F.least(n, F.col("failed_after")), F.lit(0))).otherwise(n)
    plan = docs.select("doc_id", n.alias("n"), finished.cast("bigint").alias("steps"),
                       F.array_compact(F.array(*head)).alias("head"), F.array_compact(F.array(*tail)).alias("tail"))

    def span(seq: Column, size: Column, event: Column) -> Column:
        return F.struct(seq.cast("bigint").alias("seq"), size.cast("bigint").alias("size"), event.alias("e"))

    def block(b: Column) -> Column:
        begin = b * STEPS_PER_BLOCK
        size = F.least(F.col("steps") - begin, F.lit(STEPS_PER_BLOCK).cast("bigint"))
        return span(F.size("head") + begin, size, F.lit(None).cast(_EVENT))

    no_blocks = F.array().cast("array<bigint>")
    last_block = F.floor((F.col("steps") - 1) / STEPS_PER_BLOCK)
    blocks = F.when(F.col("steps") > 0, F.sequence(F.lit(0).cast("bigint"), last_block)).otherwise(no_blocks)
    one = F.lit(1)
    spans = plan.select("doc_id", "n", F.size("head").alias("start"), F.explode(F.concat(
        F.transform("head", lambda e, i: span(i, one, e)),
        F.transform(blocks, block),
        F.transform("tail", lambda e, i: span(F.size("head") + F.col("steps") + i, one, e)),
    )).alias("s"))
    spread = spans.repartition("doc_id", F.col("s.seq"))
    rows = spread.select("doc_id", "n", "s.e", (F.col("s.seq") - F.col("start")).alias("begin"), "s.seq",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s.size") - 1)).alias("i"))
    done = F.col("begin") + F.col("i") + 1
    step = _event("progress", segment_progress(done, F.col("n")), F.format_string(fv.MSG_SEGMENT, done, "n"))
    return rows.select("doc_id", (F.col("seq") + F.col("i")).alias("seq"),
                       F.when(F.col("e").isNull(), step).otherwise(F.col("e")).alias("e")).select("doc_id", "seq", "e.*")


def cache_hit_events(hits: DataFrame) -> DataFrame:
    """A hit is a single result event with the stored payload."""
    return hits.select(
        "doc_id", F.lit(0).cast("bigint").alias("seq"), F.lit("result").alias("type"),
        F.lit(fv.STEP_END).alias("progress"), F.lit(fv.MSG_CACHE_HIT).alias("message"),
        F.col("result").alias("data"),
    )

"""From uploads to stored results: validate, look up, analyse what is new, record everything."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, check_features
from ..functions.codes import cache_key
from ..operators import inference as inf
from ..operators import progress as pr
from ..operators import state as st
from ..operators.joins import salted_lookup
from ..session import stage
from ..sources import uploads as up
from .analyze import analyze


@dataclass(frozen=True)
class Handled:
    """What a batch of uploads leads to; all tables can be appended to the stored ones.

    ``outcomes``: doc_id, key, reject (400, 413, 415 or null), hit (of the cache or
    of another upload of the batch), result, error.  ``events`` have ``data`` for
    results.  ``cache`` and ``segments`` are writes under the keys analysed,
    ``history`` operations for ``state.fold_history``, ``report`` the report rows of
    what was analysed, if reports are asked for.
    """

    outcomes: DataFrame
    events: DataFrame
    cache: DataFrame
    segments: DataFrame
    history: DataFrame
    report: DataFrame | None


def handle_uploads(uploads: DataFrame, cache: DataFrame, config: Config, features: str,
                   reader: Callable[[], up.Extractor], client_factory: Callable[[], inf.Client], now: float,
                   **analysis) -> Handled:
    """``uploads``: doc_id, filename, length, content, refresh.  ``cache``: key, result, created_at.

    Of the accepted uploads that the cache does not answer, one per key is read
    and analysed; the others with its key get what it gets.  ``now`` is the time
    of all writes.  Contents of hits, rejects and copies are never moved.
    """
    wanted = check_features(features)
    checked = up.validate(up.with_digest(uploads), config.max_body_bytes)
    key = cache_key(F.col("digest"), F.lit(config.translator), F.lit(config.target_lang), F.lit(wanted))
    checked = stage(checked.select("doc_id", "filename", "refresh", "reject", F.when(F.col("reject").isNull(), key).alias("key")), "checked")
    accepted = checked.filter("reject IS NULL")
    looked = stage(st.cache_lookup(accepted, cache), "looked-up")
    misses = looked.filter("NOT hit")
    firsts = stage(misses.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "to-analyse")

    contents = uploads.select("doc_id", "content").join(firsts.select("doc_id"), "doc_id", "left_semi")
    readings = stage(up.read_documents(contents, reader), "readings")
    out = analyze(up.pages_read(readings), config, client_factory, wanted, unread=up.without_pages(readings), **analysis)
    told = stage(out.events, "events")
    failed = told.filter("type = 'error'").select("doc_id", F.col("message").alias("error"))
    made = firsts.join(out.payloads.select("doc_id", "result"), "doc_id", "left").join(failed, "doc_id", "left")
    made = stage(made.select("key", F.col("doc_id").alias("first"), "result", "error"), "made")

    answered = salted_lookup(misses.drop("result", "hit"), made, "key", F.col("doc_id"))
    fields = ["doc_id", "filename", "key", "hit", "result", "error"]
    copies = answered.withColumn("hit", (F.col("doc_id") != F.col("first")) & F.col("error").isNull()).select(*fields)
    hits = looked.filter("hit").withColumn("error", F.lit(None).cast("string")).select(*fields)
    ended = stage(hits.unionByName(copies), "ended")
    rejects = checked.filter("reject IS NOT NULL").select("doc_id", "key", "reject")
    outcomes = ended.select("doc_id", "key", F.lit(None).cast("int").alias("reject"), "hit", "result", "error").unionByName(
        rejects.withColumn("hit", F.lit(False)), allowMissingColumns=True)

    # Copies of a failed upload get its ending; their steps were those of the first.
    late = copies.join(firsts.select("doc_id"), "doc_id", "left_anti").filter("error IS NOT NULL")
    late = late.select("doc_id", F.lit(0).cast("bigint").alias("seq"), F.lit("error").alias("type"), F.lit(100).alias("progress"),
                       F.col("error").alias("message"))
    data = made.select(F.col("first").alias("doc_id"), F.col("result").alias("data"))
    steps = told.filter("type != 'result'").unionByName(late).withColumn("data", F.lit(None).cast("string"))
    results = told.filter("type = 'result'").join(data, "doc_id", "left")
    events = steps.unionByName(results).unionByName(pr.cache_hit_events(ended.filter("hit")))

    writes = made.filter("result IS NOT NULL").select("key", "result", F.lit(now).alias("created_at"))
    names = made.select(F.col("first").alias("doc_id"), "key", F.lit(now).alias("created_at"))
    segments = salted_lookup(out.stored_segments, names, "doc_id", F.col("index"), "inner").drop("doc_id")
    return Handled(outcomes, events, writes, segments, _history(ended, now), out.report)


def _history(ended: DataFrame, now: float) -> DataFrame:
    """A create and a finish or fail operation for every accepted upload."""
    header = F.from_json("result", "total_pages bigint, report_pdf_url string")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    create = F.struct(F.lit(0).alias("seq"), F.lit("create").alias("op"), F.col("filename"), number.alias("total_pages"),
                      text.alias("report_url"), text.alias("result"), text.alias("error"))
    good = F.col("error").isNull()
    end = F.struct(F.lit(1).alias("seq"), F.when(good, "finish").otherwise("fail").alias("op"), text.alias("filename"),
                   header["total_pages"].alias("total_pages"), header["report_pdf_url"].alias("report_url"), F.col("result"), F.col("error"))
    return ended.select("doc_id", F.lit(now).alias("created_at"), F.inline(F.array(create, end)))

"""Result cache, history and job state as folds over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.codes import status_label, status_progress
from .joins import salted_lookup


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key.  An aggregate, so a key with very many rows is
    reduced inside the map tasks already."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(last.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


# --- result cache ------------------------------------------------------------


def cache_upsert(cache: DataFrame, writes: DataFrame, *order: str) -> DataFrame:
    """Cache with the writes applied, last write per key wins."""
    return latest(cache.unionByName(writes), "key", *(order or ("created_at",)))


def cached_segments(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """All segments of cache hits: ``hits`` (doc_id, key, created_at) with ``segments`` (key, created_at, index, ...).

    ``created_at`` is the version of the header that hit, so segments of a write
    that was replaced are not mixed in.
    """
    wanted = hits.select("doc_id", F.struct("key", "created_at").alias("_version"))
    stored = segments.withColumn("_version", F.struct("key", "created_at")).drop("key", "created_at")
    return salted_lookup(stored, wanted.groupBy("_version").agg(F.collect_set("doc_id").alias("_docs")), "_version", F.col("index"), "inner").select(
        F.explode("_docs").alias("doc_id"), *[c for c in stored.columns if c != "_version"])


def cache_lookup(requests: DataFrame, cache: DataFrame, spread: str = "doc_id") -> DataFrame:
    """Requests with ``result`` (null = miss).  A ``refresh`` request never hits.

    Copies of one upload share a key and may be many, so hot keys are salted.
    """
    found = cache.select("key", "result")
    joined = salted_lookup(requests, found, "key", F.col(spread))
    if "refresh" in requests.columns:
        joined = joined.withColumn("result", F.when(~F.col("refresh"), F.col("result")))
    return joined.withColumn("hit", F.col("result").isNotNull())


# --- history -----------------------------------------------------------------

# Operations: create, finish, fail, delete.  Columns of the log: doc_id, seq, op,
# filename, created_at, total_pages, report_url, result, error.


def fold_history(log: DataFrame) -> DataFrame:
    """The history table after all operations.

    create starts a fresh row; finish and fail change only their own columns and
    only while the row exists; delete removes it.
    """
    op, seq = F.col("op"), F.col("seq")

    def last(condition: Column, *cols: str) -> Column:
        return F.max(F.when(condition, F.struct("seq", *cols)))

    born = op.isin("create", "delete")
    folded = log.groupBy("doc_id").agg(
        last(born, "op", "filename", "created_at").alias("c"),
        last(op == "finish", "total_pages", "report_url", "result").alias("f"),
        last(op == "fail", "error").alias("e"),
    )
    live = folded.filter("c.op = 'create'")
    f = F.when(F.col("f.seq") > F.col("c.seq"), F.col("f"))
    e = F.when(F.col("e.seq") > F.col("c.seq"), F.col("e"))
    done_last = f.isNotNull() & (e.isNull() | (f["seq"] > e["seq"]))
    reported = f["report_url"].isNotNull() & (f["report_url"] != "")
    return live.select(
        "doc_id", F.col("c.filename").alias("filename"), F.col("c.created_at").alias("created_at"),
        F.when(done_last, "done").when(e.isNotNull(), "error").otherwise("processing").alias("status"),
        F.coalesce(f["total_pages"], F.lit(0)).alias("total_pages"),
        F.when(reported, 1).otherwise(0).alias("has_report"),
        f["result"].alias("result"), e["error"].alias("error"),
    )


def history_list(history: DataFrame, limit: int = fv.HISTORY_LIMIT) -> DataFrame:
    """The newest rows, without the heavy result column."""
    cols = ["doc_id", "filename", "created_at", "status", "total_pages", "has_report", "error"]
    newest = history.select(*cols).orderBy(F.desc("created_at"), "doc_id").limit(limit)
    return newest.withColumns({
        "created": F.timestamp_seconds("created_at"),
        "label": status_label(F.col("status")),
        "can_download": F.col("has_report") == 1,
        "can_view": F.col("status") == "done",
    })


def history_get(history: DataFrame, doc_id: str, schema) -> DataFrame:
    """One record with its payload decoded; no row when it is unknown."""
    row = history.filter(F.col("doc_id") == doc_id)
    return row.withColumn("result", F.from_json("result", schema))


def history_records(history: DataFrame, ids: DataFrame, schema) -> DataFrame:
    """A record with its payload decoded for each different id of ``ids`` (doc_id); ``found`` tells the unknown ones.

    Ids are unique in history, so no key is hot; payloads of other records are
    dropped by the join and only found ones are decoded.  A null id is not found,
    a payload that is no JSON of the schema is null.
    """
    asked = ids.select("doc_id").distinct()
    found = asked.join(history.withColumn("found", F.lit(True)), "doc_id", "left")
    return found.withColumns({"found": F.coalesce("found", F.lit(False)), "result": F.from_json("result", schema)})


def history_delete(history: DataFrame, tombstones: DataFrame) -> DataFrame:
    """History without the rows named in ``tombstones``; ids are unique in history."""
    return history.join(tombstones.select("doc_id").distinct(), "doc_id", "left_anti")


def delete_reports(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Report rows without those of deleted documents, which may be very long ones."""
    return salted_lookup(rows, tombstones.select("doc_id").distinct(), "doc_id", F.col("index"), "left_anti")


def delete_outcome(history: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(doc_id, deleted): whether each requested delete removes a row."""
    known = history.select("doc_id", F.lit(True).alias("known"))
    asked = tombstones.select("doc_id").distinct()
    return asked.join(known, "doc_id", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("deleted"))


def stale(history: DataFrame, now: Column, timeout_seconds: float) -> DataFrame:
    """Our addition: flag rows left in processing, e.g. by a crash."""
    old = (F.col("status") == "processing") & (now - F.col("created_at") > timeout_seconds)
    return history.withColumn("stale", old)


# --- jobs --------------------------------------------------------------------


def fold_jobs(events: DataFrame) -> DataFrame:
    """(doc_id, status, progress, message, error, result) from the event log.

    Needs doc_id, seq, type, progress, message, data.  ``seq`` may be any
    orderable value.  Order-free, so it runs unchanged on a stream.
    """
    kind, seq = F.col("type"), F.col("seq")

    def last(condition: Column, *cols: str) -> Column:
        return F.max(F.when(condition, F.struct("seq", *cols)))

    folded = events.groupBy("doc_id").agg(
        last(F.lit(True), "type", "progress", "message").alias("any"),
        last(kind.isin("result", "error"), "type").alias("end"),
        last(kind == "error", "message").alias("err"),
        last((kind == "result") & F.col("data").isNotNull(), "data").alias("res"),
        F.max(kind != "queued").alias("started"),
    )
    status = (
        F.when(F.col("end.type") == "result", "done")
        .when(F.col("end.type") == "error", "error")
        .when(F.col("started"), "processing")
        .otherwise("queued")
    )
    return folded.select(
        "doc_id", status.alias("status"), F.col("any.progress").alias("progress"),
        F.col("any.message").alias("message"), F.col("err.message").alias("error"), F.col("res.data").alias("result"),
    )


def partial_jobs(events: DataFrame) -> DataFrame:
    """One row per event in the form of saved job states, see ``merge_jobs``."""
    kind, seq = F.col("type"), F.col("seq").cast("long")

    def only(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    ended, failed, answered = kind.isin("result", "error"), kind == "error", (kind == "result") & F.col("data").isNotNull()
    return events.select(
        "doc_id", seq.alias("any_seq"), "type", "progress", "message", only(ended, seq).alias("end_seq"), only(ended, kind).alias("end_type"),
        only(failed, seq).alias("err_seq"), only(failed, F.col("message")).alias("error"),
        only(answered, seq).alias("res_seq"), only(answered, F.col("data")).alias("result"), (kind != "queued").alias("started"))


def merge_jobs(states: DataFrame) -> DataFrame:
    """Saved job states to one per ``doc_id``: of each kind the row with the highest sequence number."""
    kinds = {"any": ["type", "progress", "message"], "end": ["end_type"], "err": ["error"], "res": ["result"]}
    folded = states.groupBy("doc_id").agg(
        *[F.max(F.when(F.col(f"{k}_seq").isNotNull(), F.struct(f"{k}_seq", *cols))).alias(k) for k, cols in kinds.items()],
        F.max("started").alias("started"))
    return folded.select("doc_id", *[F.col(f"{k}.{c}").alias(c) for k, cols in kinds.items() for c in (f"{k}_seq", *cols)], "started")


def settle_jobs(merged: DataFrame) -> DataFrame:
    """(doc_id, status, progress, message, error, result) from merged job states."""
    status = F.when(F.col("end_type") == "result", "done").when(F.col("end_type") == "error", "error").when(F.col("started"), "processing").otherwise("queued")
    return merged.select("doc_id", status.alias("status"), "progress", "message", "error", "result")


def seed_done(hits: DataFrame) -> DataFrame:
    """Cache hits as finished jobs."""
    return hits.select(
        "doc_id", F.lit("done").alias("status"), F.lit(100).alias("progress"),
        F.lit(fv.MSG_CACHE_HIT).alias("message"), F.lit(None).cast("string").alias("error"), "result",
    )


def job_status(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """Status of every known id: the live job's, else what history says."""
    live = jobs.select("doc_id", F.struct("status", "progress", "message", "error").alias("j"))
    kept = history.select("doc_id", F.struct(
        "status", status_progress(F.col("status")).alias("progress"), F.col("status").alias("message"), "error",
    ).alias("h"))
    both = live.join(kept, "doc_id", "full_outer")
    return both.select("doc_id", F.inline(F.array(F.coalesce("j", "h"))))


def result_status(asked: DataFrame, jobs: DataFrame, history: DataFrame) -> DataFrame:
    """(doc_id, code): 200 available, 404 unknown, 500 failed, 409 not ready."""
    live = jobs.select("doc_id", F.col("result").isNotNull().alias("live"))
    kept = history.select("doc_id", F.col("status").alias("kept"),
                          F.coalesce(F.col("result") != "", F.lit(False)).alias("stored"))
    joined = asked.select("doc_id").distinct().join(live, "doc_id", "left").join(kept, "doc_id", "left")
    code = (
        F.when(F.coalesce("live", F.lit(False)), 200)
        .when(F.col("kept").isNull(), 404)
        .when(F.col("kept") == "error", 500)
        .when((F.col("kept") != "done") | ~F.col("stored"), 409)
        .otherwise(200)
    )
    return joined.select("doc_id", code.alias("code"))

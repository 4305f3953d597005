"""Queries over logs and tables: cache, history, jobs, streams, speed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..config import Config
from ..functions import codes
from ..operators import metrics
from ..operators import progress as pr
from ..operators import state as st
from ..operators.joins import salted_lookup
from ..session import scratch_dir, stage
from ..sinks.buckets import BucketTable, rewrite, rows
from ..sinks.tables import delete_history as delete_history_rows
from ..sinks.tables import upsert_cache, write_events
from ..sources.events import parse_events, read_events
from ..sources import uploads as up
from ..streaming import events as se
from ..streaming import ingest
from ..streaming import jobs as sj
from . import sql as q
from .registry import query, table
from .text_queries import documents
from .upload_flow import handle_uploads

# --- cache ------------------------------------------------------------------------

_FEATURES_SQL = ("CASE lang WHEN 'en' THEN 'summary,translate,wordcloud,report' WHEN 'fr' THEN ' report , summary,,summary' "
                 "WHEN 'de' THEN 'nosummary' ELSE '' END")


def _features() -> Column:
    return F.when(F.col("lang") == "en", "summary,translate,wordcloud,report").when(
        F.col("lang") == "fr", " report , summary,,summary").when(F.col("lang") == "de", "nosummary").otherwise("")


_KEY_SQL = (f"left(sha256(text), 16) || '|qwen|zho_Hant|' || array_to_string(list_sort(list_filter(list_transform("
            f"string_split({_FEATURES_SQL}, ','), lambda f: {q.strip('f')}), lambda f: f <> '')), ',')")


def _keyed(spark, sf_dir) -> DataFrame:
    content = codes.digest(F.encode("text", "UTF-8"))
    key = codes.cache_key(content, F.lit("qwen"), F.lit("zho_Hant"), _features())
    return documents(spark, sf_dir).select("doc_id", "lang", "source", key.alias("key"))


@query(f"""SELECT doc_id, {_KEY_SQL} AS key, contains({_FEATURES_SQL}, 'summary') AS do_summary,
contains({_FEATURES_SQL}, 'translate') AS do_translate, contains({_FEATURES_SQL}, 'wordcloud') AS do_wordcloud,
contains({_FEATURES_SQL}, 'report') AS do_report FROM documents""")
def cache_key(spark, sf_dir):
    return _keyed(spark, sf_dir).select("doc_id", "key", *[c.alias(n) for n, c in codes.feature_flags(_features()).items()])


_LOOKUP_SQL = f"""k AS (SELECT doc_id, lang, source, {_KEY_SQL} AS key FROM documents),
c AS (SELECT key, 'r' || max(doc_id) AS result FROM k WHERE lang IN ('en', 'de') GROUP BY key),
l AS (SELECT doc_id, key, source = 'src3' AS refresh, CASE WHEN source <> 'src3' THEN result END AS result FROM k LEFT JOIN c USING (key))"""


def _looked_up(spark, sf_dir) -> DataFrame:
    keyed = stage(_keyed(spark, sf_dir), "keyed")
    seen = keyed.filter("lang in ('en', 'de')").select("key", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("result"),
                                                      F.col("doc_id").cast("double").alias("created_at"))
    requests = keyed.select("doc_id", "key", (F.col("source") == "src3").alias("refresh"))
    return st.cache_lookup(requests, st.latest(seen, "key", "created_at"))


@query(f"WITH {_LOOKUP_SQL} SELECT doc_id, key, refresh, result, result IS NOT NULL AS hit FROM l")
def cache_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir)


@query(f"""WITH {_LOOKUP_SQL} SELECT doc_id, 0::BIGINT AS seq, 'result' AS type, 100 AS progress, '快取命中' AS message, result AS data,
'done' AS status FROM l WHERE result IS NOT NULL""")
def cache_hit_events(spark, sf_dir):
    hits = _looked_up(spark, sf_dir).filter("hit")
    done = st.seed_done(hits).select("doc_id", "status")
    return pr.cache_hit_events(hits).join(done, "doc_id")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS result, arg_max(value, event_id) AS created_at
FROM events GROUP BY user_id""")
def cache_upsert(spark, sf_dir):
    writes = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("result"),
                                           F.col("value").alias("created_at"), F.col("event_id").alias("seq"), "event_type")
    stored = writes.filter("event_type = 'view'").drop("event_type")
    fresh = writes.filter("event_type != 'view'").drop("event_type")
    return st.cache_upsert(stored, fresh, "seq").drop("seq")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS result, arg_max(value, event_id) AS created_at
FROM events GROUP BY user_id""")
def cache_in_buckets(spark, sf_dir):
    """Three writes to a stored cache, by kind of event."""
    cache = BucketTable(scratch_dir(spark, "cache"), "key", "key string, result string, created_at double, seq long", 64)
    writes = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("result"),
                                           F.col("value").alias("created_at"), F.col("event_id").alias("seq"), "event_type")
    for version, kinds in enumerate(("event_type = 'purchase'", "event_type = 'view'", "event_type NOT IN ('purchase', 'view')")):
        upsert_cache(cache, writes.filter(kinds).drop("event_type"), version, "seq")
    return rows(spark, cache).drop("seq")


# --- jobs ---------------------------------------------------------------------------

_JOB_EVENTS_SQL = """je AS (SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error'
    WHEN 'signup' THEN 'queued' ELSE 'progress' END AS type, CAST(floor(value) AS INTEGER) AS progress, event_type || ' ' || event_id AS message,
    CASE WHEN event_type = 'purchase' AND value > 20 THEN props END AS data FROM events)"""
_JOBS_SQL = f"""{_JOB_EVENTS_SQL}, jobs AS (SELECT doc_id,
    CASE coalesce(arg_max(type, seq) FILTER (WHERE type IN ('result', 'error')), CASE WHEN bool_and(type = 'queued') THEN 'q' ELSE 'p' END)
        WHEN 'result' THEN 'done' WHEN 'error' THEN 'error' WHEN 'q' THEN 'queued' ELSE 'processing' END AS status,
    arg_max(progress, seq) AS progress, arg_max(message, seq) AS message, arg_max(message, seq) FILTER (WHERE type = 'error') AS error,
    arg_max(data, seq) FILTER (WHERE data IS NOT NULL) AS result FROM je GROUP BY doc_id)"""


def _in_turn(rows: DataFrame, path: str, n: int) -> Iterator[None]:
    """Adds the rows to ``path`` in ``n`` turns by time, the earliest first, as a stream would bring them.

    A turn is written by as many tasks as its rows are read by.  A stream that is
    run to its end after each of them sees one batch a turn, whatever the number of files.
    """
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    turn = F.least(F.floor((F.unix_micros("ts") - low) * n / (high - low + 1)), F.lit(n - 1))
    for k in range(n):
        rows.filter(turn == k).write.mode("append").parquet(path)
        yield


def _job_events(events: DataFrame, **more: Column) -> DataFrame:
    kind = F.col("event_type")
    type_ = F.when(kind == "purchase", "result").when(kind == "error", "error").when(kind == "signup", "queued").otherwise("progress")
    return events.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), type_.alias("type"),
        F.floor("value").cast("int").alias("progress"), F.concat_ws(" ", kind, F.col("event_id").cast("string")).alias("message"),
        F.when((kind == "purchase") & (F.col("value") > 20), F.col("props")).alias("data"), *[c.alias(n) for n, c in more.items()])


@query(f"WITH {_JOBS_SQL} SELECT * FROM jobs")
def job_state(spark, sf_dir):
    return st.fold_jobs(_job_events(_events(spark, sf_dir)))


def _stream(spark, sf_dir) -> DataFrame:
    schema = _events(spark, sf_dir).schema
    return se.event_stream(spark, sf_dir, schema, "parquet", "events.parquet")


@query(f"WITH {_JOBS_SQL} SELECT * FROM jobs")
def job_state_stream(spark, sf_dir):
    out = scratch_dir(spark, "jobs")
    se.stream_jobs(_job_events(_stream(spark, sf_dir)), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return se.read_jobs(spark, f"{out}/rows")


@query(f"WITH {_JOBS_SQL} SELECT * FROM jobs")
def job_state_kept(spark, sf_dir):
    """The events in batches by time, through a state that ended jobs leave, read from a snapshot and the parts after it."""
    out = scratch_dir(spark, "jobs")
    events = _events(spark, sf_dir)
    told = _job_events(events, ts=F.col("ts").cast("timestamp"))
    for _ in _in_turn(told, f"{out}/events", 4):
        stream = spark.readStream.schema(told.schema).parquet(f"{out}/events")
        sj.keep_jobs(stream, f"{out}/states", f"{out}/checkpoint", keep_ms=1, late="1 second", snapshot_every=2).awaitTermination()
    return sj.current_jobs(spark, f"{out}/states")


@query(f"""WITH {_JOB_EVENTS_SQL} SELECT 'cache' AS target, 'k' || doc_id AS id, arg_max(data, seq) AS payload, count(*) AS writes
FROM je WHERE type = 'result' AND data IS NOT NULL GROUP BY doc_id
UNION ALL SELECT 'history', CAST(doc_id AS VARCHAR), arg_max(CASE type WHEN 'error' THEN 'fail' ELSE 'finish' END, seq), count(*)
FROM je WHERE type = 'error' OR (type = 'result' AND data IS NOT NULL) GROUP BY doc_id""")
def outcome_stream(spark, sf_dir):
    out = scratch_dir(spark, "outcomes")
    events = _job_events(_stream(spark, sf_dir)).withColumn("key", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    se.stream_outcomes(events, out, f"{out}/checkpoint").awaitTermination()
    cache = spark.read.parquet(f"{out}/cache").groupBy("key").agg(F.max_by("result", "seq").alias("payload"), F.count("*").alias("writes"))
    history = spark.read.parquet(f"{out}/history").groupBy("doc_id").agg(F.max_by("op", "seq").alias("payload"), F.count("*").alias("writes"))
    return cache.select(F.lit("cache").alias("target"), F.col("key").alias("id"), "payload", "writes").union(
        history.select(F.lit("history"), F.col("doc_id").cast("string"), "payload", "writes"))


@query(f"""WITH {_JOB_EVENTS_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, seq, type, progress, message, data FROM je""")
def ndjson_events(spark, sf_dir):
    out = scratch_dir(spark, "ndjson")
    write_events(_job_events(_events(spark, sf_dir)).withColumn("doc_id", F.col("doc_id").cast("string")), out)
    return read_events(spark, out)


@query(f"""WITH {_JOB_EVENTS_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, seq, type, progress, message, data FROM je""")
def ndjson_buffer(spark, sf_dir):
    """Events out of text buffers with blank lines, as a network reader sees them."""
    rows = _job_events(_events(spark, sf_dir)).withColumn("doc_id", F.col("doc_id").cast("string"))
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return parse_events(rows.select(F.concat(F.lit("\n  "), line, F.lit(" \r\n\n")).alias("buffer")))


# --- history --------------------------------------------------------------------------

_LOG_SQL = """lg AS (SELECT user_id AS doc_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'purchase' THEN 'finish'
    WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'view' AND value < 3 THEN 'delete' END AS op, 'f' || event_id AS filename,
    value AS created_at, CAST(floor(value) AS BIGINT) AS total_pages, CASE WHEN value > 10 THEN '/r' END AS report_url, props AS result,
    'e' || event_id AS error FROM events),
b AS (SELECT doc_id, max(seq) AS born FROM lg WHERE op IN ('create', 'delete') GROUP BY doc_id),
live AS (SELECT lg.* FROM lg JOIN b ON lg.doc_id = b.doc_id AND lg.seq = b.born WHERE op = 'create'),
after AS (SELECT lg.* FROM lg JOIN live ON lg.doc_id = live.doc_id AND lg.seq > live.seq),
hist AS (SELECT l.doc_id, l.filename, l.created_at,
    coalesce((SELECT CASE arg_max(op, seq) WHEN 'finish' THEN 'done' WHEN 'fail' THEN 'error' END FROM after a WHERE a.doc_id = l.doc_id AND op IN ('finish', 'fail')), 'processing') AS status,
    coalesce((SELECT arg_max(total_pages, seq) FROM after a WHERE a.doc_id = l.doc_id AND op = 'finish'), 0) AS total_pages,
    coalesce((SELECT arg_max(CASE WHEN created_at > 10 THEN 1 ELSE 0 END, seq) FROM after a WHERE a.doc_id = l.doc_id AND op = 'finish'), 0) AS has_report,
    (SELECT arg_max(result, seq) FROM after a WHERE a.doc_id = l.doc_id AND op = 'finish') AS result,
    (SELECT arg_max(error, seq) FROM after a WHERE a.doc_id = l.doc_id AND op = 'fail') AS error FROM live l)"""


def _history_log(spark, sf_dir) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    op = F.when(kind == "signup", "create").when(kind == "purchase", "finish").when(kind == "error", "fail").when(
        (kind == "view") & (value < 3), "delete")
    no = F.col("event_id").cast("string")
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("f"), no).alias("filename"),
        value.alias("created_at"), F.floor(value).alias("total_pages"), F.when(value > 10, "/r").alias("report_url"),
        F.col("props").alias("result"), F.concat(F.lit("e"), no).alias("error"))


@query(f"WITH {_LOG_SQL} SELECT * FROM hist")
def history_fold(spark, sf_dir):
    return st.fold_history(_history_log(spark, sf_dir))


_ORDERS_SQL = """h AS (SELECT o_orderkey AS doc_id, 'order-' || o_orderkey || '.pdf' AS filename,
    CAST(date_diff('second', TIMESTAMP '2000-01-01', o_orderdate) AS DOUBLE) AS created_at,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'error' ELSE 'processing' END AS status,
    CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS has_report,
    CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS error FROM orders)"""


def _orders_history(spark, sf_dir) -> DataFrame:
    day0 = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
        F.timestamp_diff("SECOND", day0, F.col("o_orderdate")).cast("double").alias("created_at"),
        F.when(status == "F", "done").when(status == "P", "error").otherwise("processing").alias("status"),
        F.lit(0).cast("bigint").alias("total_pages"), F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("has_report"),
        F.lit(None).cast("string").alias("result"), F.when(status == "P", F.col("o_orderpriority")).alias("error"))


@query(f"""WITH {_ORDERS_SQL} SELECT doc_id, filename, created_at, status, 0::BIGINT AS total_pages, has_report, error, status AS label,
has_report = 1 AS can_download, status = 'done' AS can_view,
strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(created_at AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS created FROM h ORDER BY created_at DESC, doc_id LIMIT 200""")
def history_list(spark, sf_dir):
    listed = st.history_list(_orders_history(spark, sf_dir))
    return listed.withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


_TOMBSTONES_SQL = "t AS (SELECT DISTINCT CASE WHEN l_linestatus = 'F' THEN l_orderkey ELSE -l_orderkey END AS doc_id FROM lineitem WHERE l_returnflag = 'R')"


def _tombstones(spark, sf_dir) -> DataFrame:
    doc = F.when(F.col("l_linestatus") == "F", F.col("l_orderkey")).otherwise(-F.col("l_orderkey"))
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(doc.alias("doc_id"))


@query(f"WITH {_ORDERS_SQL}, {_TOMBSTONES_SQL} SELECT doc_id, filename, status FROM h WHERE doc_id NOT IN (SELECT doc_id FROM t)")
def history_delete(spark, sf_dir):
    return st.history_delete(_orders_history(spark, sf_dir), _tombstones(spark, sf_dir)).select("doc_id", "filename", "status")


@query(f"WITH {_ORDERS_SQL}, {_TOMBSTONES_SQL} SELECT doc_id, filename, status FROM h WHERE doc_id NOT IN (SELECT doc_id FROM t)")
def history_in_buckets(spark, sf_dir):
    """A stored history, then the deletes."""
    history = BucketTable(scratch_dir(spark, "history"), "doc_id", "doc_id long, filename string, status string", 64)
    rewrite(history, _orders_history(spark, sf_dir).select("doc_id", "filename", "status"), lambda old, new: old.unionByName(new), 0)
    delete_history_rows(history, _tombstones(spark, sf_dir), 1)
    return rows(spark, history)


@query(f"""WITH {_TOMBSTONES_SQL} SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS idx, l_shipdate::VARCHAR AS text FROM lineitem
WHERE l_orderkey NOT IN (SELECT doc_id FROM t)""")
def report_delete(spark, sf_dir):
    """Stored report rows, of which an order has one a line, without those of deleted documents."""
    stored = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("index"),
                                                     F.col("l_shipdate").cast("string").alias("text"))
    return st.delete_reports(stored, _tombstones(spark, sf_dir)).select("doc_id", F.col("index").alias("idx"), "text")


@query("""WITH asked AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS doc_id FROM orders)
SELECT doc_id, c_custkey IS NOT NULL AS found, CASE WHEN c_acctbal > 0 THEN c_name END AS name,
    CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS BIGINT) END AS n_segments, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS keyword
FROM asked LEFT JOIN customer ON c_custkey = doc_id""")
def history_records(spark, sf_dir):
    """Records of the customers that ordered, with their payloads; negative ids are unknown, some payloads damaged."""
    payload = F.to_json(F.struct(F.col("c_name").alias("language"), F.col("c_nationkey").cast("long").alias("n_segments"),
                                 F.array("c_mktsegment").alias("keywords")))
    history = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"),
                                                      F.when(F.col("c_acctbal") > 0, payload).otherwise("{").alias("result"))
    owner = F.col("o_custkey")
    asked = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", -owner).otherwise(owner).alias("doc_id"))
    records = st.history_records(history, asked, "language string, n_segments long, keywords array<string>")
    return records.select("doc_id", "found", F.col("result.language").alias("name"), "result.n_segments", F.col("result.keywords")[0].alias("keyword"))


@query(f"WITH {_TOMBSTONES_SQL} SELECT doc_id, doc_id IN (SELECT o_orderkey FROM orders) AS deleted FROM t")
def delete_outcome(spark, sf_dir):
    return st.delete_outcome(_orders_history(spark, sf_dir), _tombstones(spark, sf_dir))


_CUSTOMERS_SQL = """ch AS (SELECT c_custkey AS doc_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'done' WHEN 'MACHINERY' THEN 'error' ELSE 'processing' END AS status,
    CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS result, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name END AS error FROM customer)"""


def _customers_history(spark, sf_dir) -> DataFrame:
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.when(segment == "BUILDING", "done").when(segment == "MACHINERY", "error").otherwise("processing").alias("status"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("result"),
        F.when(segment == "MACHINERY", F.col("c_name")).alias("error"))


@query(f"""WITH {_JOBS_SQL}, {_CUSTOMERS_SQL}, ids AS (SELECT user_id AS doc_id FROM events UNION SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)
SELECT ids.doc_id, CASE WHEN jobs.result IS NOT NULL THEN 200 WHEN ch.status IS NULL THEN 404 WHEN ch.status = 'error' THEN 500
WHEN ch.status <> 'done' OR ch.result = '' THEN 409 ELSE 200 END AS code
FROM ids LEFT JOIN jobs USING (doc_id) LEFT JOIN ch USING (doc_id)""")
def result_status(spark, sf_dir):
    jobs = st.fold_jobs(_job_events(_events(spark, sf_dir)))
    history = _customers_history(spark, sf_dir)
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).union(
        table(spark, sf_dir, "orders").select("o_custkey")).union(history.select("doc_id"))
    return st.result_status(asked, jobs, history)


@query(f"""WITH {_JOBS_SQL}, {_CUSTOMERS_SQL}
SELECT doc_id, status, progress, message, error FROM jobs UNION ALL
SELECT doc_id, status, CASE WHEN status = 'done' THEN 100 ELSE 0 END, status, error FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM jobs)""")
def job_status(spark, sf_dir):
    return st.job_status(st.fold_jobs(_job_events(_events(spark, sf_dir))), _customers_history(spark, sf_dir))


# --- speed ------------------------------------------------------------------------------

@query("""WITH r AS (SELECT user_id AS run_id, CASE event_type WHEN 'view' THEN 'summary' WHEN 'click' THEN 'translation' WHEN 'purchase' THEN 'overview'
    WHEN 'signup' THEN 'extract' ELSE 'other' END AS kind, value AS elapsed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tok FROM events),
s AS (SELECT run_id, count(*) FILTER (WHERE kind = 'summary') AS n, coalesce(sum(elapsed) FILTER (WHERE kind = 'extract'), 0) AS et,
    coalesce(sum(elapsed) FILTER (WHERE kind IN ('summary', 'overview')), 0) AS st, coalesce(sum(tok) FILTER (WHERE kind IN ('summary', 'overview')), 0)::BIGINT AS sk,
    coalesce(sum(elapsed) FILTER (WHERE kind = 'translation'), 0) AS tt, coalesce(sum(tok) FILTER (WHERE kind = 'translation'), 0)::BIGINT AS tk,
    coalesce(sum(tok % 10) FILTER (WHERE kind = 'translation'), 0)::BIGINT AS ts FROM r GROUP BY run_id)
SELECT run_id, n AS n_segments, round(et, 6) AS extract_time, round(st, 6) AS summary_time, sk AS summary_tokens, round(tt, 6) AS translate_time,
    tk AS translate_tokens, ts AS translate_sentences, round(CASE WHEN st > 0 THEN sk / st ELSE 0 END, 6) AS summary_tokens_per_sec,
    round(CASE WHEN n > 0 THEN st / (n + 1) ELSE 0 END, 6) AS summary_avg_time, round(CASE WHEN tt > 0 THEN tk / tt ELSE 0 END, 6) AS translate_tokens_per_sec,
    round(CASE WHEN tt > 0 THEN ts / tt ELSE 0 END, 6) AS translate_sentences_per_sec, round(et + st + tt, 6) AS total_time FROM s""")
def speed_report(spark, sf_dir):
    kind = F.col("event_type")
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    responses = _events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"),
        F.when(kind == "view", "summary").when(kind == "click", "translation").when(kind == "purchase", "overview").when(
            kind == "signup", "extract").otherwise("other").alias("kind"),
        F.col("value").alias("elapsed"), tokens.alias("completion_tokens"), (tokens % 10).alias("n_sentences"))
    report = metrics.speed_report(responses)
    return report.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes])


# --- uploads as a stream ------------------------------------------------------------

@query("SELECT DISTINCT left(sha256(coalesce(text, '')), 16) AS digest, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length, 1::BIGINT AS copies FROM documents")
def upload_stream(spark, sf_dir):
    """Documents as uploads in four batches, with copies within and across them: each content is stored once."""
    out = scratch_dir(spark, "uploads")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sent = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filename"), content.alias("content"),
                                                    F.timestamp_seconds("doc_id").alias("ts"))
    sent = up.with_digest(sent.withColumn("length", F.octet_length("content").cast("long")))
    for _ in _in_turn(sent, f"{out}/sent", 4):
        stream = spark.readStream.schema(sent.schema).parquet(f"{out}/sent")
        ingest.store_uploads(stream.drop("ts"), f"{out}/stored", f"{out}/checkpoint", buckets=64, merge_every=2).awaitTermination()
    stored = spark.read.parquet(f"{out}/stored")
    return stored.groupBy("digest", "length").agg(F.count("*").alias("copies"))


# --- uploads to stored results ------------------------------------------------------

def _fails_on(mark: bytes):
    def read(content: bytes) -> list[str]:
        if content.startswith(mark):
            raise ValueError("unreadable")
        return up.text_pages(content)

    return read


_UPLOADS_SQL = """u AS (SELECT 'd' || doc_id AS doc_id, CASE WHEN source = 'src2' THEN 'x.txt' ELSE source || '.PDF' END AS filename,
    CASE WHEN source = 'src4' THEN '' WHEN source = 'src5' THEN '%! ' || text ELSE text END AS content, lang, source = 'src3' AS refresh FROM documents)"""


def _uploads(spark, sf_dir) -> DataFrame:
    """Documents as uploads: some of a wrong type, some empty, some that the reader fails on."""
    source, text = F.col("source"), F.col("text")
    content = F.when(source == "src4", "").when(source == "src5", F.concat(F.lit("%! "), text)).otherwise(text)
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.when(source == "src2", "x.txt").otherwise(F.concat(source, F.lit(".PDF"))).alias("filename"),
        F.encode(content, "UTF-8").alias("content"), "lang", (source == "src3").alias("refresh"))
    return rows.withColumn("length", F.octet_length("content").cast("long"))


@query(f"""WITH {_UPLOADS_SQL},
c AS (SELECT *, CASE WHEN content = '' THEN 400 WHEN lower(filename) NOT LIKE '%.pdf' THEN 415 END AS reject FROM u),
seen AS (SELECT content, 'r' || max(content) AS result FROM c WHERE reject IS NULL AND lang = 'de' GROUP BY content),
pages AS (SELECT DISTINCT content AS doc_id, 0 AS page_no, content AS text FROM c WHERE reject IS NULL AND content NOT LIKE '!%!!%' ESCAPE '!'),
{q.classified('pages')},
good AS (SELECT doc_id AS content FROM classified WHERE meaningful AND clean <> ''),
firsts AS (SELECT content, min(doc_id) AS first FROM c WHERE reject IS NULL AND (refresh OR content NOT IN (SELECT content FROM seen)) GROUP BY content),
o AS (SELECT doc_id, filename, reject, CASE WHEN reject IS NULL AND NOT refresh THEN result END AS cached, first,
    CASE WHEN content LIKE '!%!!%' ESCAPE '!' THEN '處理失敗：unreadable' WHEN content NOT IN (SELECT content FROM good) THEN '{fv.MSG_NO_TEXT}' END AS problem
    FROM c LEFT JOIN seen USING (content) LEFT JOIN firsts USING (content))
SELECT doc_id, reject, reject IS NULL AND (cached IS NOT NULL OR (doc_id <> first AND problem IS NULL)) AS hit,
    CASE WHEN reject IS NULL AND cached IS NULL THEN problem END AS error,
    CASE WHEN reject IS NULL THEN CASE WHEN cached IS NULL AND problem IS NOT NULL THEN 'error' ELSE 'done' END END AS status
FROM o""")
def upload_flow(spark, sf_dir):
    uploads = stage(_uploads(spark, sf_dir), "uploads")
    key = codes.cache_key(codes.digest(F.col("content")), F.lit(fv.WINDOW_TRANSLATOR), F.lit(fv.TARGET_LANGUAGE), F.lit("wordcloud"))
    seen = uploads.filter("lang = 'de'").select(key.alias("key"), F.concat(F.lit("r"), F.decode("content", "UTF-8")).alias("result"), F.lit(1.0).alias("created_at"))
    cache = st.cache_upsert(seen.limit(0), seen)
    handled = handle_uploads(uploads, cache, Config(), "wordcloud", lambda: _fails_on(b"%!"), lambda: None, now=2.0)
    history = st.fold_history(handled.history).select("doc_id", "status")
    return handled.outcomes.join(history, "doc_id", "left").select("doc_id", "reject", "hit", "error", "status")


def _pages_of_lines(content: bytes) -> list[str]:
    """A reader of pages of six lines."""
    lines = _fails_on(b"%!")(content)[0].split("\n")
    return ["\n".join(lines[at:at + 6]) for at in range(0, len(lines), 6)]


def _model():
    """A stand-in model that tells lengths and says windows again, and fails on some of each."""
    summary, prefix, overview = fv.SUMMARY_SYSTEM, len(fv.SUMMARY_PREFIX), fv.OVERVIEW_SYSTEM

    def say(system: str, user: str, max_tokens: int, temperature: float) -> tuple[str, int]:
        n = len(user) - (prefix if system == summary else 0)
        every, problem = (41, "busy") if system == summary else (37, "no overview") if system == overview else (43, "no window")
        if n % every == 0:
            raise ValueError(problem)
        if system == summary:
            return f"<think>hm</think> {n}", n
        if system == overview:
            return (f"結論\n{n}\n行動\nread" if n % 2 == 0 else f"all {n}"), n
        return f"> {user}", n

    return say


_FLOW_CHARS = 2000
_UNREADABLE = "content LIKE '!%!!%' ESCAPE '!'"
_FAILED = fv.MSG_FAILED.replace("%s", "")


@query(f"""WITH RECURSIVE {_UPLOADS_SQL},
c AS (SELECT *, CASE WHEN content = '' THEN 400 WHEN lower(filename) NOT LIKE '%.pdf' THEN 415 END AS reject FROM u),
kinds AS (SELECT content, min(doc_id) AS k FROM c WHERE reject IS NULL GROUP BY content),
pages_in AS (SELECT k AS doc_id, (i - 1) // 6 AS page_no, string_agg(ls[i], chr(10) ORDER BY i) AS text FROM
    (SELECT k, string_split(content, chr(10)) AS ls FROM kinds WHERE NOT {_UNREADABLE}), generate_series(1, len(ls)) AS g(i) GROUP BY 1, 2),
{q.classified('pages_in')},
kept AS (SELECT doc_id, page_no, clean AS text FROM classified WHERE meaningful AND clean <> ''),
{q.packed('kept', _FLOW_CHARS)},
keyed AS (SELECT doc_id || '#' || idx AS doc_id, original AS text FROM chunks),
{q.window_walk('keyed')},
said AS (SELECT split_part(doc_id, '#', 1) AS doc_id, CAST(split_part(doc_id, '#', 2) AS BIGINT) AS idx, win_idx, win FROM wins),
broken AS (SELECT doc_id, idx, 'busy' AS error, idx * 1000000 AS place FROM chunks WHERE length(original) % 41 = 0
    UNION ALL SELECT doc_id, idx, 'no window', idx * 1000000 + 1 + win_idx FROM said WHERE length(win) % 43 = 0),
failed AS (SELECT doc_id, arg_min(error, place) AS error, min(idx) AS steps FROM broken GROUP BY doc_id),
whole AS (SELECT doc_id, count(*) AS n_chunks, length({q.text(fv.OVERVIEW_PREFIX)} || string_agg(
    '[段落 ' || (idx + 1) || ']' || chr(10) || length(original), chr(10) || chr(10) ORDER BY idx)) AS z FROM chunks GROUP BY doc_id),
fate AS (SELECT content, k, n_chunks, z, coalesce(failed.steps, n_chunks, 0) AS steps,
    CASE WHEN {_UNREADABLE} THEN '{_FAILED}unreadable' WHEN n_chunks IS NULL THEN '{fv.MSG_NO_TEXT}'
         WHEN error IS NOT NULL THEN '{_FAILED}' || error WHEN z % 37 = 0 THEN '{_FAILED}no overview' END AS problem
    FROM kinds LEFT JOIN whole ON whole.doc_id = k LEFT JOIN failed ON failed.doc_id = k),
seen AS (SELECT DISTINCT content FROM c JOIN fate USING (content) WHERE reject IS NULL AND lang = 'de' AND problem IS NULL),
o AS (SELECT doc_id, content, reject, reject IS NULL AND NOT refresh AND content IN (SELECT content FROM seen) AS cached FROM c),
firsts AS (SELECT content, min(doc_id) AS first FROM o WHERE reject IS NULL AND NOT cached GROUP BY content),
e AS (SELECT o.*, k, z, steps, n_chunks, problem, coalesce(doc_id = first, false) AS ran FROM o LEFT JOIN fate USING (content) LEFT JOIN firsts USING (content)),
seg AS (SELECT doc_id AS k, idx, CAST(length(original) AS VARCHAR) AS summary, t AS translated FROM chunks
    JOIN (SELECT doc_id, idx, string_agg({q.strip("'> ' || win")}, chr(10) ORDER BY win_idx) AS t FROM said GROUP BY 1, 2) USING (doc_id, idx))
SELECT doc_id, reject, reject IS NULL AND problem IS NULL AND NOT ran AS hit, CASE WHEN reject IS NULL THEN problem END AS error,
    CASE WHEN reject IS NULL THEN CASE WHEN problem IS NULL THEN 'done' ELSE 'error' END END AS status,
    CASE WHEN reject IS NULL AND problem IS NULL THEN CASE WHEN z % 2 = 0 THEN CAST(z AS VARCHAR) ELSE 'all ' || z END END AS overview,
    CASE WHEN ran THEN steps ELSE 0 END AS n_steps,
    CASE WHEN ran AND problem IS NULL THEN 7 * n_chunks + CASE WHEN z % 2 = 0 THEN 8 ELSE 5 END ELSE 0 END AS n_report,
    idx, summary, translated
FROM e LEFT JOIN seg ON seg.k = e.k AND reject IS NULL AND problem IS NULL""")
def upload_flow_model(spark, sf_dir):
    """Two batches with all features and a model: the first stores results that the second hits; then every result is looked up."""
    uploads = stage(_uploads(spark, sf_dir), "uploads")
    config = Config(max_chunk_chars=_FLOW_CHARS)

    def handle(batch: DataFrame, cache: DataFrame, now: float):
        return handle_uploads(batch, cache, config, fv.FEATURES, lambda: _pages_of_lines, _model, now=now)

    nothing = spark.createDataFrame([], "key string, result string, created_at double")
    early = handle(uploads.filter("lang = 'de'"), nothing, 1.0)
    known = stage(early.cache, "cache")
    late = handle(uploads, known, 2.0)
    cache = st.cache_upsert(known, late.cache)
    outcomes = stage(late.outcomes, "outcomes")

    versions = salted_lookup(outcomes.filter("result IS NOT NULL").select("doc_id", "key"), cache.select("key", "created_at"),
                             "key", F.col("doc_id"), "inner")
    segments = st.cached_segments(versions, early.segments.unionByName(late.segments)).select(
        "doc_id", F.col("index").alias("idx"), "summary", "translated")
    steps = late.events.filter(F.col("message").startswith(fv.MSG_SEGMENT.split("%")[0])).groupBy("doc_id").agg(F.count("*").alias("n_steps"))
    report = late.report.groupBy("doc_id").agg(F.count("*").alias("n_report"))
    status = st.fold_history(late.history).select("doc_id", "status")
    said = F.from_json("result", "global_summary struct<conclusion:string,raw:string>")["global_summary"]
    told = outcomes.withColumn("overview", F.coalesce(F.nullif(said["conclusion"], F.lit("")), said["raw"])).select(
        "doc_id", "reject", "hit", "error", "overview")
    for side in (status, steps, report):
        told = told.join(side, "doc_id", "left")
    return told.fillna(0, ["n_steps", "n_report"]).join(segments, "doc_id", "left")

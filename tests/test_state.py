import json
import os

from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.config import Config, check_features, check_steps
from pagewright.operators import metrics
from pagewright.operators import progress as pr
from pagewright.operators import state as st
from pagewright.plans.analyze import analyze
from pagewright.schemas import EVENT, RESULT
from pagewright.sinks import tables as sinks
from pagewright.sources import events as se
from pagewright.sources import uploads as up
from pagewright.sources.html import html_pages, html_text
from pagewright.streaming import events as stream
from pagewright.streaming import ingest

import pytest


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, total_pages long, n_chunks long, language string, skip_translation boolean, "
                                       "do_summary boolean, do_wordcloud boolean, do_report boolean, error string, failed_after long")


def numbers(events):
    return [(r.type, r.progress) for r in events.orderBy("seq").collect()]


def test_progress_of_seven_segments(spark, monkeypatch):
    plain = docs(spark, [("d", 9, 7, "en", False, True, True, True, None, None)])
    want = [3, 15, 25, 36, 47, 57, 68, 79, 90, 90, 93, 97, 100]
    assert [p for _, p in numbers(pr.progress_events(plain))] == want
    monkeypatch.setattr(pr, "STEPS_PER_BLOCK", 3)
    events = pr.progress_events(plain).orderBy("seq").collect()
    assert [e.progress for e in events] == want and [e.seq for e in events] == list(range(13))
    assert events[1].message == "擷取完成：9 頁 → 有效內容 7 段" and events[8].message == "完成第 7/7 段"


def test_progress_of_special_documents(spark):
    def run(*fields):
        return numbers(pr.progress_events(docs(spark, [("d", 5, *fields)])))

    assert run(0, "en", True, True, True, True, None, None) == [("progress", 3), ("progress", 15), ("error", 100)]
    assert run(1, "zh", True, False, False, False, None, None) == [("progress", 3), ("progress", 15), ("progress", 16), ("progress", 90), ("result", 100)]
    assert run(4, "en", False, True, True, True, "boom", 2) == [("progress", 3), ("progress", 15), ("progress", 33), ("progress", 52), ("error", 100)]
    assert run(4, "en", False, True, True, True, "boom", -1) == [("progress", 3), ("error", 100)]
    assert run(1, "en", False, True, True, True, "boom", 1) == [("progress", 3), ("progress", 15), ("progress", 90), ("progress", 90), ("error", 100)]


LOG = "doc_id string, seq long, op string, filename string, created_at double, total_pages long, report_url string, result string, error string"


def test_history_follows_the_operations(spark):
    def create(d, s):
        return (d, s, "create", f"{d}.pdf", float(s), None, None, None, None)

    def finish(d, s, url="/r"):
        return (d, s, "finish", None, None, 4, url, "{}", None)

    def fail(d, s):
        return (d, s, "fail", None, None, None, None, None, "oops")

    def delete(d, s):
        return (d, s, "delete", None, None, None, None, None, None)

    rows = [create("open", 1), create("done", 2), finish("done", 3), create("bad", 4), fail("bad", 5), finish("ghost", 6),
            create("again", 7), finish("again", 8), create("again", 9), create("gone", 10), delete("gone", 11), finish("gone", 12),
            create("both", 13), finish("both", 14, ""), fail("both", 15)]
    got = {r.doc_id: r for r in st.fold_history(spark.createDataFrame(rows, LOG)).collect()}
    assert set(got) == {"open", "done", "bad", "again", "both"}
    assert (got["done"].status, got["done"].total_pages, got["done"].has_report, got["done"].result) == ("done", 4, 1, "{}")
    assert (got["bad"].status, got["bad"].error, got["bad"].total_pages) == ("error", "oops", 0)
    assert (got["again"].status, got["again"].has_report, got["again"].result) == ("processing", 0, None)
    assert (got["both"].status, got["both"].result, got["both"].has_report) == ("error", "{}", 0)


def test_jobs_and_result_codes(spark):
    rows = [("a", 0, "queued", 0, "", None), ("b", 0, "progress", 3, "m", None), ("c", 0, "progress", 3, "m", None),
            ("c", 1, "result", 100, "ok", "{}"), ("d", 0, "progress", 15, "m", None), ("d", 1, "error", 100, "bad", None)]
    jobs = st.fold_jobs(spark.createDataFrame(rows, EVENT))
    got = {r.doc_id: (r.status, r.progress, r.error, r.result) for r in jobs.collect()}
    assert got == {"a": ("queued", 0, None, None), "b": ("processing", 3, None, None), "c": ("done", 100, None, "{}"), "d": ("error", 100, "bad", None)}

    history = spark.createDataFrame([("h1", "done", "{}", None), ("h2", "done", None, None), ("h3", "error", None, "x"), ("h4", "processing", None, None), ("d", "error", None, "x")],
                                    "doc_id string, status string, result string, error string")
    asked = spark.createDataFrame([(x,) for x in ("c", "h1", "h2", "h3", "h4", "d", "nobody", "a")], "doc_id string")
    codes = dict(map(tuple, st.result_status(asked, jobs, history).collect()))
    assert codes == {"c": 200, "h1": 200, "h2": 409, "h3": 500, "h4": 409, "d": 500, "nobody": 404, "a": 404}
    status = {r.doc_id: (r.status, r.progress) for r in st.job_status(jobs, history).collect()}
    assert status["h1"] == ("done", 100) and status["h4"] == ("processing", 0) and status["d"] == ("error", 100)


def test_cache_keeps_the_last_write_and_refresh_misses(spark):
    schema = "key string, result string, created_at double"
    cache = st.cache_upsert(spark.createDataFrame([("k", "old", 1.0), ("m", "m", 1.0)], schema), spark.createDataFrame([("k", "new", 2.0)], schema))
    assert sorted((r.key, r.result) for r in cache.collect()) == [("k", "new"), ("m", "m")]
    asked = spark.createDataFrame([("1", "k", False), ("2", "k", True), ("3", "zz", False)], "doc_id string, key string, refresh boolean")
    found = st.cache_lookup(asked, cache)
    assert sorted((r.doc_id, r.result, r.hit) for r in found.collect()) == [("1", "new", True), ("2", None, False), ("3", None, False)]
    assert [(r.type, r.progress, r.data) for r in pr.cache_hit_events(found.filter("hit")).collect()] == [("result", 100, "new")]
    assert st.seed_done(found.filter("hit")).first().status == "done"


def test_history_views(spark):
    rows = [(f"d{i:03}", f"f{i}", float(i // 2), "done" if i % 2 else "queued", 1, i % 2, None, None) for i in range(250)]
    history = spark.createDataFrame(rows, "doc_id string, filename string, created_at double, status string, total_pages long, has_report int, result string, error string")
    top = st.history_list(history).collect()
    assert len(top) == 200 and [r.doc_id for r in top[:3]] == ["d248", "d249", "d246"] and "result" not in top[0].asDict()
    assert (top[1].label, top[1].can_download, top[1].can_view) == ("done", True, True) and top[0].label == "processing"
    gone = spark.createDataFrame([("d000",), ("nope",)], "doc_id string")
    assert st.history_delete(history, gone).count() == 249
    assert dict(map(tuple, st.delete_outcome(history, gone).collect())) == {"d000": True, "nope": False}
    assert st.history_get(history, "nope", RESULT).count() == 0
    stored = history.withColumn("result", F.lit('{"language":"en","keywords":["a"]}'))
    assert st.history_get(stored, "d001", RESULT).first().result.keywords == ["a"]
    late = history.withColumn("status", F.lit("processing"))
    assert st.stale(late, F.lit(200.0), 100).filter("stale").count() == 200
    reports = spark.createDataFrame([("d000", 0), ("d000", 1), ("d001", 0)], "doc_id string, index int")
    assert [r.doc_id for r in st.delete_reports(reports, gone).collect()] == ["d001"]


def test_speed_report_counts_the_overview_as_a_segment(spark):
    rows = [("r", "summary", 2.0, 10, 0), ("r", "summary", 4.0, 20, 0), ("r", "overview", 3.0, 15, 0), ("r", "translation", 0.0, 5, 2), ("q", "extract", 1.0, 0, 0)]
    got = {r.run_id: r for r in metrics.speed_report(spark.createDataFrame(rows, "run_id string, kind string, elapsed double, completion_tokens long, n_sentences long")).collect()}
    assert (got["r"].summary_time, got["r"].summary_avg_time, got["r"].summary_tokens_per_sec) == (9.0, 3.0, 5.0)
    assert (got["r"].translate_tokens_per_sec, got["q"].summary_avg_time, got["q"].total_time) == (0.0, 0.0, 1.0)


def test_ndjson_keeps_nulls_and_text(spark, tmp_path):
    events = spark.createDataFrame([("d", 0, "progress", 3, "擷取 €", None), ("d", 1, "result", 100, "ok", '{"a":1}')], EVENT)
    out = str(tmp_path / "events")
    sinks.write_events(events, out)
    lines = [line for f in os.listdir(out) if f.startswith("part") for line in open(os.path.join(out, f), encoding="utf8")]
    assert any('"data":null' in line and "擷取 €" in line for line in lines)
    assert sorted(map(tuple, se.read_events(spark, out).collect())) == sorted(map(tuple, events.collect()))
    buffers = spark.createDataFrame([("\n".join(["", *lines, "  "]),)], "buffer string")
    assert se.parse_events(buffers).count() == 2


def write(path, content):
    path.write_bytes(content)


def test_uploads(spark, tmp_path):
    for name, content in [("a.PDF", b"one\x0ctwo "), ("b.pdf", b"one\x0ctwo "), ("c.pdf", b"\xff\xfe"), ("d.txt", b"x"), ("e.pdf", b"")]:
        write(tmp_path / name, content)
    files = up.scan_uploads(spark, str(tmp_path))
    checked = {r.filename: r.reject for r in up.validate(files, 100).collect()}
    assert checked == {"a.PDF": None, "b.pdf": None, "c.pdf": None, "d.txt": 415}
    keyed = up.with_digest(files)
    first = up.first_copies(keyed, "filename")
    assert sorted((r.filename, r.n_copies) for r in first.collect()) == [("a.PDF", 2), ("c.pdf", 1), ("d.txt", 1)]
    out = str(tmp_path / "store")
    sinks.write_uploads(keyed, first, out, "filename")
    sinks.write_uploads(keyed, first, out, "filename")
    assert spark.read.parquet(out).count() == 3
    again = spark.createDataFrame([("a.pdf", b"X"), ("b.pdf", b"X"), ("b.pdf", b"Y"), ("a.pdf", b"X")], "filename string, content binary")
    again = up.with_digest(again)
    sinks.write_uploads(again, up.first_copies(again, "filename"), str(tmp_path / "again"), "filename")
    assert spark.read.parquet(str(tmp_path / "again")).count() == 2

    docs_in = keyed.select(F.col("filename").alias("doc_id"), "content")

    def picky():
        def extract(content):
            if content.startswith(b"\xff"):
                raise ValueError("unreadable")
            return up.text_pages(content)
        return extract

    pages = up.extract_pages(docs_in, picky)
    assert [(r.page_no, r.text) for r in pages.filter("doc_id = 'a.PDF'").orderBy("page_no").collect()] == [(0, "one"), (1, "two")]
    assert pages.filter("doc_id = 'c.pdf'").count() == 0
    readings = up.read_documents(docs_in, picky)
    assert {tuple(r) for r in up.without_pages(readings).collect()} == {("c.pdf", "unreadable")}
    assert up.pages_read(readings).count() == pages.count()
    texts = spark.createDataFrame([("d", "a \f\fb")], "doc_id string, text string")
    assert [r.text for r in up.split_pages(texts).orderBy("page_no").collect()] == ["a", "", "b"]


def test_html(one):
    page = "<html><head><style>p{}</style><script>var a='</p>';</script></head><body><nav>menu</nav><p>A &amp;lt; B<br>C</p><!-- no --><div>D<b>E</b></div></body></html>"
    assert one(html_text, page) == "A &lt; B\nC\nDE"
    assert one(html_text, "<p>&copy; a&nbsp;b &mdash; &#123;x&#x7D; &#x1F600; &#150;&amp;#65; &unknown; & &; &#0; &#xD800; &#1114112; &CounterClockwiseContourIntegral;</p>") == (
        "\u00a9 a b \u2014 {x} \U0001f600 \u2013&#65; &unknown; & &; \ufffd \ufffd \ufffd \u2233")


def test_html_as_a_page_table(spark):
    rows = spark.createDataFrame([(1, "<p>a</p><p>b &eacute;</p>"), (2, None), (3, "")], "page_id long, html string")
    assert sorted(map(tuple, html_pages(rows, "page_id", "html").collect())) == [("1", 0, "a\nb \u00e9"), ("2", 0, ""), ("3", 0, "")]


def test_report_sink_is_ordered(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, 0, 0, "segment", "s"), ("d", 0, -1, 0, "title", "t"), ("d", 1, 0, 1, "body", "b")],
                                 "doc_id string, section int, index long, ord int, kind string, text string")
    out = tmp_path / "report"
    sinks.write_report(rows, str(out))
    text = "".join((out / f).read_text() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert text == "# t\n### s\nb\n"


def test_streams_equal_batch_and_survive_restart(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    first = [("a", 0, "progress", 3, "m", None), ("b", 0, "progress", 3, "m", None)]
    second = [("a", 1, "result", 100, "ok", "{}"), ("c", 0, "error", 100, "bad", None)]

    def put(name, rows):
        names = [f.name for f in EVENT]
        (src / name).write_text("".join(json.dumps(dict(zip(names, r))) + "\n\n" for r in rows))

    def state():
        stream.stream_jobs(stream.event_stream(spark, str(src)), out, check).awaitTermination()
        return sorted(map(tuple, stream.read_jobs(spark, out).collect()), key=str)

    put("1.json", first)
    state()
    put("2.json", second)
    batch = st.fold_jobs(spark.createDataFrame(first + second, EVENT))
    assert state() == sorted(map(tuple, batch.collect()), key=str)

    events = stream.event_stream(spark, str(src)).withColumn("key", F.col("doc_id"))
    stream.stream_outcomes(events, str(tmp_path / "eff"), str(tmp_path / "check2")).awaitTermination()
    assert [(r.key, r.result) for r in spark.read.parquet(str(tmp_path / "eff/cache")).collect()] == [("a", "{}")]
    ops = {(r.doc_id, r.op, r.error) for r in spark.read.parquet(str(tmp_path / "eff/history")).collect()}
    assert ops == {("a", "finish", None), ("c", "fail", "bad")}


def test_ingest_stores_each_content_once(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    for name, content in [("a", b"1"), ("b", b"1"), ("c", b"2")]:
        write(src / name, content)
    ingest.store_uploads(ingest.upload_stream(spark, str(src)), out, check).awaitTermination()
    for name, content in [("d", b"1"), ("e", b"3")]:
        write(src / name, content)
    ingest.store_uploads(ingest.upload_stream(spark, str(src)), out, check).awaitTermination()
    assert sorted(bytes(r.content) for r in spark.read.parquet(out).collect()) == [b"1", b"2", b"3"]


def test_throughput_windows(spark):
    rows = [("2024-01-01 00:10:00", "result"), ("2024-01-01 00:50:00", "result"), ("2024-01-01 01:10:00", "error"), ("2024-01-01 01:11:00", "progress")]
    events = spark.createDataFrame(rows, "ts string, type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.type, r.n) for r in stream.throughput(events, "ts").collect()) == [("error", 1), ("result", 2)]


def test_settings():
    assert Config.from_env({"MAX_CHUNK_CHARS": "x", "MAX_BODY_MB": "7"}).max_chunk_chars == 6000
    assert Config.from_env({"MAX_BODY_MB": "7"}).max_body_bytes == 7 << 20
    assert Config().use_traditional and not Config(target_lang="zho_Hans").use_traditional
    assert not Config.from_env({"DISABLE_OCR": "1"}).ocr
    with pytest.raises(ValueError):
        check_features(" , ")
    with pytest.raises(ValueError):
        check_steps(False, False)


def test_analysis_end_to_end(spark):
    line = "this is a line with enough words number %d to count as prose"
    body = "\n".join(line % i for i in range(6))
    pages = spark.createDataFrame(
        [("good", 0, body), ("good", 1, "12"), ("good", 2, body.upper()), ("bad", 0, body + "\nfail please right here and now"), ("empty", 0, "x")],
        "doc_id string, page_no long, text string")

    def factory():
        def client(system, user, max_tokens, temperature):
            if "fail please" in user and "摘要" in user:
                raise RuntimeError("model down")
            return ("結論\n好\n行動\ngo" if user.startswith(fv.OVERVIEW_PREFIX) else f"<{len(user)}>"), 7
        return client

    unread = spark.createDataFrame([("broken", "unreadable"), ("blank", None)], "doc_id string, error string")
    out = analyze(pages, Config(max_chunk_chars=400), factory, fv.FEATURES, unread=unread)
    results = {r.doc_id: r for r in out.results.collect()}
    assert set(results) == {"good"}
    good = results["good"]
    assert (good.total_pages, good.n_chunks, good.language) == (3, 2, "en")
    assert good.global_summary.conclusion == "好" and good.global_summary.action == "go"
    assert good.report_pdf_url == "/documents/good/report.pdf" and "line" in good.keywords
    payload = json.loads(out.payloads.filter("doc_id = 'good'").first().result)
    assert sorted(r["index"] for r in out.stored_segments.collect()) == [0, 1] and payload["n_segments"] == 2 and payload["wordcloud_image_url"] is None
    ends = {(r.doc_id, r.type, r.message) for r in out.events.filter("progress = 100").collect()}
    assert ends == {("broken", "error", "處理失敗：unreadable"), ("blank", "error", fv.MSG_NO_TEXT), ("good", "result", fv.MSG_DONE), ("bad", "error", "處理失敗：model down"), ("empty", "error", fv.MSG_NO_TEXT)}
    assert {r.doc_id for r in out.report.collect()} == {"good"}
    assert out.segments.filter("translated is not null").count() == 3

    by_sentence = analyze(pages, Config(max_chunk_chars=400, translator="other"), factory, "translate",
                          translators={"other": lambda: lambda texts, source: [source + "!" for _ in texts]})
    assert all(set(r.translated.split(" ")) == {"eng_Latn!"} for r in by_sentence.segments.collect())

    plain = analyze(pages, Config(target_lang="eng_Latn"), factory, "translate")
    assert plain.responses.count() == 0 and plain.report is None and plain.keywords is None


def test_all_segments_come_back_from_the_cache(spark):
    headers = spark.createDataFrame([("k", 1.0, "old"), ("k", 2.0, "new"), ("other", 1.0, "o")], "key string, created_at double, result string")
    cache = st.cache_upsert(headers.limit(0).select("key", "result", "created_at"), headers.select("key", "result", "created_at"))
    rows = spark.range(1500).selectExpr("'k' AS key", "2.0D AS created_at", "id AS index", "concat('s', id) AS original")
    stored = rows.unionByName(rows.limit(20).withColumn("created_at", F.lit(1.0)))
    hits = spark.createDataFrame([("d1", "k"), ("d2", "k")], "doc_id string, key string").join(cache, "key")
    got = st.cached_segments(hits, stored)
    assert {(r.doc_id, r.n, r.top) for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("index").alias("top")).collect()} == {
        ("d1", 1500, 1499), ("d2", 1500, 1499)}


def test_records_by_id(spark):
    history = spark.createDataFrame([("a", "done", '{"total_pages": 3}'), ("b", "error", None), ("c", "done", "no json")], "doc_id string, status string, result string")
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("z",), (None,)], "doc_id string")
    got = {r.doc_id: r for r in st.history_records(history, ids, "total_pages long").collect()}
    assert set(got) == {"a", "b", "c", "z", None}
    assert got["a"].result.total_pages == 3 and got["a"].found and got["b"].found and got["b"].result is None
    assert got["c"].found and (got["c"].result is None or got["c"].result.total_pages is None)
    assert not got["z"].found and not got[None].found and got["z"].status is None
    assert st.history_records(history.limit(0), ids, "total_pages long").filter("found").count() == 0

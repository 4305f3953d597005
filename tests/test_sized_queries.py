"""Queries on inputs that the given tables have only at size."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as driver
from check import normal
from pagewright.functions import replies
from pagewright.operators import assemble as asm
from pagewright.operators import inference as inf
from pagewright.operators import keywords as kw
from pagewright.operators import requests as rq
from pagewright.plans import state_queries as sq
from pagewright.plans import text_queries as tq
from pagewright.streaming.jobs import JobStates

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over given documents (doc_id, text, lang, source)."""

    def run(name, rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
        df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        got, want = normal(driver.queries()[name](spark, str(tmp_path)).toPandas()), normal(con.sql(driver.oracle_sql()[name]).df())
        assert list(got.columns) == list(want.columns)
        return [sorted(map(repr, df.itertuples(index=False, name=None))) for df in (got, want)]

    return run


def test_texts_without_a_gram_have_no_language_row(both):
    got, want = both("language_profile", [(1, "the cat sat on the mat", "en", "a"), (2, "no", "en", "a"), (3, "", "fr", "a"), (4, "le chat est la", "fr", "a")])
    assert got == want and len(got) == 2


def test_ties_round_as_in_sql(spark):
    values = [-529928.4025, -533223.1105, -263169.8525, -12.0005, -1.5, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    con = duckdb.connect()
    want = [con.execute("select round(?::double, 3)", [v]).fetchone()[0] for v in values]
    assert [r[0] for r in df.select(tq._thousandths(df.x)).collect()] == want


def test_turns_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id", "timestamp_seconds(id) AS ts").repartition(4)
    seen = []
    for _ in sq._in_turn(rows, str(tmp_path / "sent"), 4):
        sent = spark.read.parquet(str(tmp_path / "sent"))
        seen.append((sent.count(), len(sent.inputFiles())))
    assert seen == [(1000 * k, 4 * k) for k in (1, 2, 3, 4)]


class _Handle:
    """A state store of one job that counts what it is asked."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_a_running_job_asks_the_state_store_twice_a_batch():
    handle, jobs = _Handle(), JobStates(keep_ms=10, lost_ms=1000)
    jobs.init(handle)

    def batch(*rows):
        handle.calls = 0
        return [list(jobs.handleInputRows((7,), iter([Row(seq=s, type=t, progress=s, message=f"m{s}", data=None, ms=ms) for s, t, ms in rows]), None)), handle.calls]

    def expire(at):
        handle.timers.discard(at)
        list(jobs.handleExpiredTimer((7,), None, type("Info", (), {"getExpiryTimeInMs": lambda self: at})()))

    assert batch((1, "queued", 100), (2, "progress", 110))[1] == 3 and handle.timers == {1110}
    said, calls = batch((3, "progress", 300))
    assert calls == 2 and handle.timers == {1110} and said[0].any_seq == 3 and said[0].started
    expire(1110)
    assert handle.value is not None and handle.timers == {1300}  # put off: the last event was at 300
    batch((4, "result", 400))
    assert handle.timers == {410}
    expire(410)
    assert handle.value is None


def test_sentence_batches_come_without_nested_rows(spark):
    chunks = spark.createDataFrame([(1, "en", "One. Two. Bad."), (2, "fr", "Un. Deux.")], "doc_id long, lang string, original string").withColumn("index", F.lit(0))

    def translate(texts, source):
        if source == "fr":
            raise ValueError("no French")
        return [f"{source} {t}" for t in texts]

    said = inf.run_batches(rq.sentence_requests(chunks, F.col("lang")), lambda: translate, batch_size=2, tasks=1)
    assert "mapInArrow" in said._jdf.queryExecution().analyzed().toString() or "MapInArrow" in said._jdf.queryExecution().analyzed().toString()
    rows = [tuple(r) for r in said.select("doc_id", "index", "win_idx", "text", "completion_tokens", "error").orderBy("doc_id", "win_idx").collect()]
    assert rows == [(1, 0, 0, "en One.", 0, None), (1, 0, 1, "en Two.", 0, None), (1, 0, 2, "en Bad.", 0, None),
                    (2, 0, 0, None, 0, "no French"), (2, 0, 1, None, 0, "no French")]


def test_script_mapping_holds_few_texts(spark):
    held = []

    class Batch:
        """An Arrow array of which only slices may become Python's."""

        def __init__(self, array):
            self.array = array

        def __len__(self):
            return len(self.array)

        def slice(self, low, n):
            held.append(n)
            return self.array.slice(low, n)

    texts = pa.array([None if i % 7 == 0 else f"是不{i}" for i in range(300)])
    mapped = replies.map_slices(Batch(texts), replies.phrase_mapper({"是": "昰"}, {"是不": "不是"}))
    assert mapped.to_pylist() == [None if i % 7 == 0 else f"不是{i}" for i in range(300)] and max(held) <= 64
    df = spark.createDataFrame([(None,), ("",), ("是不是",)], "t string")
    assert [r[0] for r in df.select(replies.to_traditional(df.t, {"是": "昰"}, {"是不": "不是"})).collect()] == [None, "", "不是昰"]


_WORDY = [(1, "Beta alpha BETA the gamma-ray alpha beta. Delta alpha? No.", "en", "a"), (2, "", "en", "a"), (3, None, "fr", "b"), (4, "a be the and", "fr", "b"),
          (5, "omega " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)) + " omega", "en", "c"), (6, "Alpha one. Alpha two alpha!", "en", "c")]
_IN_PARTS = [(7, "kappa kappa kappa lambda", "de", "d"), (7, "sigma rho lambda lambda kappa", "de", "d")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("more", [[], _IN_PARTS, _IN_PARTS + [(n, t, "en", "e") for n in range(8, 20) for t in ("mu nu xix", "xix xix ypsilon ypsilon ypsilon")]])
def test_documents_of_one_row_and_in_parts_have_the_keywords_of_sql(both, more):
    got, want = both("keywords_topk", _WORDY + more)
    assert got == want and len(got) > 60


def test_a_summary_shuffles_no_words(spark, both):
    got, want = both("extractive_summary", _WORDY)
    assert got == want and len(got) == 6
    df = driver.queries()["extractive_summary"](spark, SF_DIR)
    assert "Exchange" in _plan(df) and not [x for x in _plan(df).splitlines() if "Exchange" in x and "word#" in x.split("hashpartitioning")[-1]]


@pytest.mark.parametrize("more", [[], _IN_PARTS])
def test_terms_of_whole_documents_are_counted_without_a_shuffle(spark, both, more):
    got, want = both("tfidf_keywords", _WORDY + more)
    assert got == want and len(got) > 60
    df = spark.createDataFrame([r[:2] for r in _WORDY + more], "doc_id long, text string").withColumn("ord", F.lit(0))
    counted = _plan(kw.term_counts(df))
    assert ("hashpartitioning" in counted) == bool(more)


def test_keywords_of_whole_documents_are_ranked_without_a_shuffle(spark):
    assert "hashpartitioning" not in _plan(driver.queries()["keywords_topk"](spark, SF_DIR))


def test_segments_and_replies_meet_in_one_shuffle(spark):
    rows = [("d", 3, "d3"), ("d", 0, "d0"), ("d", 1, ""), ("d", 2, None), ("d", 4, "d4"), ("e", 0, "e0"), (None, 0, "n0")]
    said = [("d", 0, "S0"), ("d", 3, None), ("d", 4, "S4"), ("d", 9, "no chunk"), ("f", 0, "no document"), (None, 0, "no id"), ("e", None, "no index"), ("d", 1, "")]
    told = [("d", 0, "T0"), ("d", 2, "T2"), ("d", 3, "T3"), ("e", 0, "T"), (None, 0, "no id"), ("d", 90, "no chunk")]
    chunks = spark.createDataFrame(rows, "doc_id string, index long, original string")
    summaries, translations = (spark.createDataFrame(r, "doc_id string, index int, text string") for r in (said, told))

    def flat(nested):
        return sorted(map(repr, nested.collect()))

    for sides in ((summaries, translations), (summaries, None), (None, translations), (None, None)):
        for per_row in (1, 2, 10):
            want = asm.nest_segments(asm.assemble_segments(chunks, *sides), per_row)
            got = asm.nest_replies(chunks, *sides, per_row)
            assert flat(got) == flat(want) and got.schema.simpleString() == want.schema.simpleString()
    plan = _plan(driver.queries()["segments_nested"](spark, SF_DIR))
    assert "Join" not in plan and plan.count("hashpartitioning") == 1

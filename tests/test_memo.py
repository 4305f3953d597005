"""Replies kept by request: no question is asked twice."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import memo
from pagewright.schemas import REQUESTS


def asking(*questions, temperature=0.2):
    return [(str(i), 0, 0, "summary", [("system", "s"), ("user", t)], temperature, 10) for i, t in enumerate(questions)]


def frame(spark, rows):
    return spark.createDataFrame(rows, REQUESTS).repartition(3)


def says(word):
    return lambda: lambda system, user, max_tokens, temperature: (f"{word} {user}", 3)


def refusing():
    def client(system, user, max_tokens, temperature):
        raise RuntimeError("no calls wanted")

    return lambda: client


fails = refusing()


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "replies")


def test_equal_requests_are_one_call(spark, store):
    rows = asking(*["same"] * 50, "other", "same")
    got = memo.ask_once(frame(spark, rows), says("a"), store).collect()
    assert len(got) == 52 and sum(not r.hit for r in got) == 2
    assert {(r.text, r.error) for r in got} == {("a same", None), ("a other", None)}


def test_second_run_sends_no_call(spark, store):
    rows = asking("x", "y", "z", None)
    first = memo.ask_once(frame(spark, rows), says("a"), store).collect()
    again = memo.ask_once(frame(spark, rows), fails, store).collect()
    assert sorted((r.doc_id, r.text, r.completion_tokens) for r in again) == sorted((r.doc_id, r.text, r.completion_tokens) for r in first)
    assert all(r.hit and r.error is None for r in again)


def test_what_a_reply_depends_on(spark, store):
    memo.ask_once(frame(spark, asking("x")), says("a"), store, model="m1").collect()
    for rows, model in ((asking("x"), "m2"), (asking("x", temperature=0.3), "m1"), ([(*asking("x")[0][:6], 11)], "m1"), (asking("x "), "m1")):
        got = memo.ask_once(frame(spark, rows), says("b"), store, model=model).collect()
        assert [(r.hit, r.text[0]) for r in got] == [(False, "b")]
    assert memo.ask_once(frame(spark, asking("x")), fails, store, model="m1").first().text == "a x"


def test_failures_are_asked_again(spark, store):
    rows = asking("x", "y")
    bad = memo.ask_once(frame(spark, rows), fails, store).collect()
    assert {(r.text, r.error, r.hit) for r in bad} == {(None, "no calls wanted", False)}
    good = memo.ask_once(frame(spark, rows), says("a"), store).collect()
    assert {(r.text, r.error, r.hit) for r in good} == {("a x", None, False), ("a y", None, False)}
    assert all(r.hit for r in memo.ask_once(frame(spark, rows), fails, store).collect())


def test_waves_survive_a_lost_run(spark, store, monkeypatch):
    """A run that dies between waves leaves the replies it has; the next one asks for the rest."""
    rows = asking(*(f"q{i}" for i in range(40)))
    real, done = memo.run_inference, []

    def dies(*args, **more):
        if len(done) == 2:
            raise RuntimeError("driver lost")
        done.append(1)
        return real(*args, **more)

    monkeypatch.setattr(memo, "run_inference", dies)
    with pytest.raises(RuntimeError):
        memo.ask_once(frame(spark, rows), says("a"), store, calls_per_task=3, calls_at_once=10)
    monkeypatch.setattr(memo, "run_inference", real)
    kept = memo.replies(spark, store).count()
    assert 0 < kept < 40
    got = memo.ask_once(frame(spark, rows), says("b"), store, calls_per_task=3, calls_at_once=10).collect()
    assert len(got) == 40 and sum(r.text.startswith("a ") for r in got) == sum(r.hit for r in got) == kept


def test_compacted_store_answers_the_same(spark, store, tmp_path):
    rows = asking("x", "y")
    memo.ask_once(frame(spark, rows), fails, store)
    memo.ask_once(frame(spark, rows), says("a"), store)
    target = str(tmp_path / "small")
    memo.compact_replies(spark, store, target, 1)
    assert memo.replies(spark, target).count() == 2
    assert {r.text for r in memo.ask_once(frame(spark, rows), fails, target).collect()} == {"a x", "a y"}


def test_no_requests(spark, store):
    assert memo.ask_once(frame(spark, asking("x")).limit(0), fails, store).count() == 0
    assert memo.ask_once(frame(spark, asking("x")), says("a"), store).filter(F.col("hit")).count() == 0

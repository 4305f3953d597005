"""Job states as a stream: what leaves the state store stays in the table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagewright.operators import state as st
from pagewright.streaming import jobs as sj

SCHEMA = "doc_id string, seq long, type string, progress int, message string, data string, ts timestamp"
START = datetime(2024, 1, 1)


def event(doc, seq, kind, minute, data=None):
    return (doc, seq, kind, seq % 100, f"{kind} {seq}", data, START + timedelta(minutes=minute))


def run(spark, batches, tmp_path, **more):
    """The batches one after another; the state rows that the last batch left behind."""
    events, out = str(tmp_path / "events"), str(tmp_path / "states")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(events)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(events)
    query = sj.keep_jobs(stream, out, str(tmp_path / "checkpoint"), **more)
    query.awaitTermination()
    return out, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def rows_of(df):
    return sorted(map(repr, df.select("doc_id", "status", "progress", "message", "error", "result").collect()))


@pytest.fixture(scope="module")
def story():
    """Ten jobs that end, one by one, two that never do, and one that starts again long after its end."""
    batches = []
    for k in range(5):
        rows = []
        for i in (2 * k, 2 * k + 1):
            rows += [event(f"j{i}", 1, "queued", 100 * k), event(f"j{i}", 2, "progress", 100 * k + 1),
                     event(f"j{i}", 3, "error" if i % 3 == 0 else "result", 100 * k + 2, None if i % 3 == 0 else f"r{i}")]
        rows += [event("slow", k + 1, "progress", 100 * k)]
        batches.append(rows)
    batches[4] += [event("j0", 4, "queued", 402), event("new", 1, "queued", 402)]
    return batches


def test_jobs_leave_the_state_and_stay_in_the_table(spark, tmp_path, story):
    out, left = run(spark, story, tmp_path, keep_ms=60_000, late="1 second", snapshot_every=2)
    everything = spark.createDataFrame([e for rows in story for e in rows], SCHEMA)
    assert rows_of(sj.current_jobs(spark, out)) == rows_of(st.fold_jobs(everything)) == rows_of(sj.jobs_of(everything))
    assert sj.last_snapshot(spark, out) >= 3
    # Two values a job (state and timer): the jobs of the first batches are gone.
    kept, _ = run(spark, story, tmp_path / "long", keep_ms=10**12, late="1 second")
    _, all_left = run(spark, story, tmp_path / "again", keep_ms=10**12, late="1 second")
    assert left <= all_left / 2
    assert rows_of(sj.current_jobs(spark, kept)) == rows_of(st.fold_jobs(everything))


def test_snapshot_that_was_not_noted_is_not_read(spark, tmp_path, story):
    out, _ = run(spark, story, tmp_path, snapshot_every=2)
    want = rows_of(sj.current_jobs(spark, out))
    spark.createDataFrame([("x", 1)], "doc_id string, any_seq long").write.parquet(f"{out}/snapshots/upto=99")
    assert rows_of(sj.current_jobs(spark, out)) == want


def test_merging_parts_in_any_order(spark):
    rng = random.Random(5)
    rows = [event(f"d{rng.randrange(20)}", i, rng.choice(("queued", "progress", "result", "error")), i, rng.choice((None, f"r{i}"))) for i in range(400)]
    events = spark.createDataFrame(rows, SCHEMA)
    parts = [st.merge_jobs(st.partial_jobs(events.filter(F.col("seq") % 3 == k))) for k in range(3)]
    merged = st.merge_jobs(parts[2].unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[0]))
    assert rows_of(st.settle_jobs(merged)) == rows_of(st.fold_jobs(events))

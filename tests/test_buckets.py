"""Tables in buckets: what a write touches, what a crash leaves, what a repeat does."""

import os

import pytest

from pagewright.operators import state
from pagewright.sinks import buckets as b
from pagewright.sinks.tables import delete_history, upsert_cache
from pagewright.streaming import ingest

CACHE = "key string, result string, created_at double"


def cache(tmp_path, n=8):
    return b.BucketTable(str(tmp_path / "cache"), "key", CACHE, n)


def rows_of(spark, table):
    return sorted(map(tuple, b.rows(spark, table).collect()), key=str)


def test_writes_give_what_the_fold_of_all_writes_gives(spark, tmp_path):
    table = cache(tmp_path)
    assert rows_of(spark, table) == []
    first = spark.createDataFrame([(f"k{i}", "old", 1.0) for i in range(100)] + [(None, "no key", 1.0)], CACHE)
    second = spark.createDataFrame([(f"k{i}", "new", 2.0) for i in range(0, 100, 7)] + [("more", "new", 2.0), (None, None, 2.0)], CACHE)
    for version, writes in enumerate((first, second, second.limit(0))):
        upsert_cache(table, writes, version)
    assert rows_of(spark, table) == sorted(map(tuple, state.cache_upsert(first, second).collect()), key=str)
    assert rows_of(spark, table) == rows_of(spark, b.BucketTable(table.path, "key", CACHE, 8))
    assert {r.result for r in b.rows(spark, table, before=1).collect()} == {"old", "no key"}


def test_a_write_touches_the_buckets_of_its_keys(spark, tmp_path):
    table = cache(tmp_path, 64)
    upsert_cache(table, spark.range(5000).selectExpr("concat('k', id) AS key", "'old' AS result", "1.0D AS created_at"), 0)
    upsert_cache(table, spark.createDataFrame([("k77", "new", 2.0)], CACHE), 1)
    written = [f for f in os.listdir(f"{table.path}/whole=1") if f.startswith("_bucket=")]
    assert len(written) == 1
    files = b.rows(spark, table).inputFiles()
    assert sum("whole=1" in f for f in files) == 1 and b.rows(spark, table).count() == 5000
    number = next(iter(b.touched(table, spark.createDataFrame([("k77", "", 0.0)], CACHE))))
    assert {r.key for r in b.rows(spark, table, {number}).filter("result = 'new'").collect()} == {"k77"}
    assert all(f"_bucket={number}/" in f for f in b.rows(spark, table, {number}).inputFiles())


def test_a_write_that_dies_before_its_note_leaves_the_table(spark, tmp_path, monkeypatch):
    table = cache(tmp_path)
    old = spark.createDataFrame([("a", "1", 1.0), ("b", "1", 1.0)], CACHE)
    new = spark.createDataFrame([("a", "2", 2.0)], CACHE)
    upsert_cache(table, old, 0)
    def dies(table, df, version, numbers):
        df.selectExpr("*", "0 AS _bucket").write.partitionBy("_bucket").parquet(f"{table.path}/whole={version}")
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(b, "_put", dies)
        with pytest.raises(RuntimeError):
            upsert_cache(table, new, 1)
    assert rows_of(spark, table) == [("a", "1", 1.0), ("b", "1", 1.0)]
    for _ in range(2):  # the repeat, and a repeat of the repeat
        upsert_cache(table, new, 1)
        assert rows_of(spark, table) == [("a", "2", 2.0), ("b", "1", 1.0)]


def test_deletes_may_empty_a_bucket(spark, tmp_path):
    table = b.BucketTable(str(tmp_path / "history"), "doc_id", "doc_id long, status string", 4)
    b.rewrite(table, spark.range(20).selectExpr("id AS doc_id", "'done' AS status"), lambda old, new: old.unionByName(new), 0)
    delete_history(table, spark.createDataFrame([(1,), (1,), (99,), (None,)], "doc_id long"), 1)
    assert [r.doc_id for r in b.rows(spark, table).orderBy("doc_id").collect()] == [0, *range(2, 20)]
    delete_history(table, spark.range(20).selectExpr("id AS doc_id"), 2)
    assert b.rows(spark, table).count() == 0
    b.rewrite(table, spark.createDataFrame([(5, "again")], "doc_id long, status string"), lambda old, new: old.unionByName(new), 3)
    assert rows_of(spark, table) == [(5, "again")]


def test_added_rows_are_merged(spark, tmp_path):
    table = b.BucketTable(str(tmp_path / "digests"), "digest", "digest string", 4)
    for version in range(5):
        b.add(table, spark.range(10).selectExpr(f"concat('{version}-', id) AS digest"), version)
    before = len(b.rows(spark, table).inputFiles())
    want = {f"{v}-{i}" for v in range(5) for i in range(10)}
    for _ in range(2):
        b.merge(spark, table, 4, parts=2)
        got = [r.digest for r in b.rows(spark, table).collect()]
        assert len(got) == 50 and set(got) == want
    assert len(b.rows(spark, table).inputFiles()) == 4 < before
    b.add(table, spark.createDataFrame([("x",)], "digest string"), 5)
    assert b.rows(spark, table).count() == 51 and b.rows(spark, table, before=5).count() == 50


def test_ingest_reads_no_stored_content(spark, tmp_path):
    schema = "filename string, length long, content binary, digest string"
    out, sent = str(tmp_path / "out"), str(tmp_path / "sent")
    contents = [[1, 1, 2], [2, 3, 1], [3, 4, 4], [5, 1, 6]]
    for k, batch in enumerate(contents):
        rows = [(f"{k}-{i}", 1, str(c).encode(), f"d{c}") for i, c in enumerate(batch)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(sent)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(sent)
        ingest.store_uploads(stream, out, str(tmp_path / "check"), buckets=4, merge_every=2).awaitTermination()
        if k == 1:  # Stored contents may be out of reach by now.
            os.rename(f"{out}/part=0", tmp_path / "away")
    kept = [bytes(r.content) for p in (f"{out}/part=1", f"{out}/part=2", f"{out}/part=3", str(tmp_path / "away")) for r in spark.read.schema(schema).parquet(p).collect()]
    assert sorted(kept) == [b"1", b"2", b"3", b"4", b"5", b"6"]
    assert sorted(r.digest for r in b.rows(spark, ingest.digest_table(out, 4)).collect()) == [f"d{i}" for i in range(1, 7)]

"""Every stage of the pipeline against plain Python over that stage's own input."""

from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import mixing, rule_ensemble
from pagewright.session import stage

from .test_corpus_operators import brute_components

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The input of every stage and the last one's output, with an extra column of a clashing name."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("score", F.col("doc_id") * 2)
    docs = docs.unionByName(spark.createDataFrame([(9001, None, "en", "src0", 0, 1), (9002, "", None, None, 0, 1)], docs.schema))
    docs = docs.unionByName(docs.filter("doc_id = 3"))
    out = [stage(docs, "p")]
    for _, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SF_DIR), "p"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert tables[-1].columns == [*tables[0].columns, "shard", "slot"]
    assert all(t.filter("score <> doc_id * 2 AND doc_id < 9000").count() == 0 for t in tables)


def test_quality_drops_what_scores_low(spark, tables):
    model = rule_ensemble.train(tables[0], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    want = {r.doc_id for r in rule_ensemble.score_documents(tables[0], model).filter("predicted = 1").collect()}
    assert set(rows(tables[1])) == want
    judged = tables[1].join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id")
    assert judged.filter("quality = 0").count() <= 0.05 * judged.count()


def test_one_document_of_each_group_stays(tables):
    before = sorted({(r.doc_id, r.text) for r in tables[1].collect()})
    component, _ = brute_components(before, corpus_pipeline.SIMILAR)
    assert sorted(r.doc_id for r in tables[2].collect()) == sorted(set(component.values()))


def test_benchmark_passages_go(spark, tables):
    from pagewright.llm import queries

    con = duckdb.connect()
    con.register("documents", tables[2].toPandas())
    con.execute(f"create view benchmark as select * from read_parquet('{SF_DIR}/benchmark.parquet')")
    want = {r[0] for r in con.sql(queries.ORACLES["op2_phrase_index"]).filter("not contaminated").fetchall()}
    assert set(rows(tables[3])) == want


def test_mix_repeats_whole_documents(tables):
    taken = {r.doc_id: r for r in mixing.taken_words(tables[3]).collect()}
    got = defaultdict(int)
    for r in tables[4].collect():
        got[r.doc_id] += 1
    assert set(got) <= {d for d, r in taken.items() if r.size}
    for d, r in taken.items():
        if r.size:
            assert r.taken // r.size <= got[d] <= -(-r.taken // r.size) <= 2


def test_mix_comes_near_the_targets(tables):
    """Each source's words are within one of its documents of its target."""
    targets = {r.source: r for r in mixing.source_targets(tables[3].withColumn("size", mixing.n_words())).collect()}
    longest = {r.source: r.n for r in tables[3].groupBy("source").agg(F.max(mixing.n_words()).alias("n")).collect()}
    got = {r.source: r.n for r in tables[4].groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).collect()}
    for source, t in targets.items():
        assert abs(got.get(source, 0) - t.target) <= longest[source] + 0.5


def test_shards_hold_everything(tables):
    out = tables[5].toPandas()
    assert sorted(out["doc_id"]) == sorted(r.doc_id for r in tables[4].collect())
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_no_documents_give_no_documents(spark, tables):
    docs = tables[0].limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF_DIR), "p")
    assert docs.count() == 0

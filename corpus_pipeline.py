"""From raw documents to shards: five stages, each over all that the one before kept.

Every stage takes and returns a table of documents; it is written as Parquet and
read again by the next, so a lost executor costs part of one stage.  The last
stage adds the shard and the slot of every document.

Documents are told apart by doc_id and text; a null doc_id counts as a value.
Further columns pass through whatever their names.  Whole texts are read, of any
length.  What nulls, ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bbit_minhash, mixing, phrase_index, rule_ensemble, shards
from pagewright.session import scratch_dir

N_SHARDS = 8
SIMILAR = 80  # per cent of the shingles of two near duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more.

    Null and empty texts have the statistics of an empty text and are scored by
    them; equal texts have equal scores and go or stay together.
    """
    model = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_ensemble.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    A null doc_id comes last.  Null, empty and blank texts are duplicates of
    nothing and stay; of rows that repeat doc_id and text one stays.
    """
    return bbit_minhash.deduplicated(docs, SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and wordless texts hold no window and stay, as all do if the benchmark
    is empty; of repeated rows all go or all stay.
    """
    return phrase_index.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to twice.

    A null source is a source; texts without words have no size and are not
    taken.  Rows that repeat doc_id and text share what they take.  Rows are
    numbered by content, so the layout of the files does not matter.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard and slot they are written to.

    Null and empty texts are rows of one byte; equal texts share a shard unless
    they overfill a range.  Columns called shard or slot are replaced.
    """
    return shards.shard(docs, F.xxhash64("text", F.col("text").isNull()), F.col("doc_id"), shards.row_size(), N_SHARDS)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate),
          ("mixing sources", mix), ("sharding", shard)]

# The first stage is a trained model, which SQL cannot say; tests/llm compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

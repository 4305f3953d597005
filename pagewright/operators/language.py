"""Language of a document: script first, character statistics otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from .frames import let
from .joins import hot_keys, salted_lookup

GRAM = 3
MAX_BROADCAST_GRAMS = 100_000
MAX_LANGUAGES = 200


def document_scripts(texts: DataFrame) -> DataFrame:
    """(doc_id, script) from the summed character counts of all parts."""
    counted = let(texts, c=tx.script_counts(F.col("text")))
    sums = counted.groupBy("doc_id").agg(*[F.sum(f"c.{n}").alias(n) for n in ("dense", "han", "kana", "hangul")])
    return sums.select("doc_id", tx.script_from_counts(
        F.col("dense"), F.col("han"), F.col("kana"), F.col("hangul")).alias("script"))


def document_heads(chunks: DataFrame, chars: int, max_chunk_chars: int = fv.CHUNK_CHARS) -> DataFrame:
    """The first ``chars`` characters of each document, chunks joined by a line break.

    Two neighbouring chunks together exceed the chunk budget, so a few leading
    chunks always suffice and the rest is never touched.
    """
    enough = 2 * (chars // max_chunk_chars + 1)
    rows = F.array_sort(F.collect_list(F.struct("index", F.left("original", F.lit(chars)).alias("t"))))
    joined = F.array_join(F.transform(rows, lambda r: r["t"]), "\n")
    return (
        chunks.filter(F.col("index") < enough)
        .groupBy("doc_id")
        .agg(F.left(joined, F.lit(chars)).alias("text"))
    )


def train_profile(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) from (lang, text): character 3-gram counts per language."""
    grams = labelled.select("lang", F.explode(tx.grams(F.col("text"), GRAM)).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.count("*").alias("n"))


def languages_of(profile: DataFrame) -> list[str]:
    """The languages of a stored profile: a handful of names."""
    names = profile.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"a profile may hold at most {MAX_LANGUAGES} languages")
    return sorted(r["lang"] for r in names)


def classify(texts: DataFrame, profile: DataFrame) -> DataFrame:
    """(doc_id, language, score) by the add-one smoothed 3-gram model.

    score(lang) = sum over grams of ln(n+1)  -  grams * ln(total(lang) + V)

    A gram the language never showed adds ln(1) = 0.  Every language is a column,
    so one pass over the grams sums them all.  Grams that make up more than
    1/MAX_BROADCAST_GRAMS of the profile are broadcast and summed within the map
    task; the rare rest is counted per document first and joined by shuffle.

    ``profile`` is read several times and should be a stored table.
    """
    langs = languages_of(profile)
    names = [f"w{i}" for i in range(len(langs))]
    seen = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)) for lang in langs]
    weights = profile.groupBy("gram").agg(F.sum("n").alias("n"), *[F.ln(n + 1).alias(w) for n, w in zip(seen, names)])
    totals = profile.agg(F.count_distinct("gram").alias("V"), F.array(*seen).alias("totals"))
    hot = hot_keys(weights, "n", profile.agg(F.sum("n").alias("total")), MAX_BROADCAST_GRAMS).withColumn("hot", F.lit(True)).drop("n")

    grams = texts.select("doc_id", F.explode_outer(tx.grams(F.col("text"), GRAM)).alias("gram"))
    rare = F.when(F.col("hot").isNull(), F.col("gram")).alias("rare")
    part = grams.join(F.broadcast(hot), "gram", "left").groupBy("doc_id", rare).agg(
        F.count("gram").alias("c"), *[F.sum(F.coalesce(F.col(w), F.lit(0.0))).alias(w) for w in names])
    # Rows without a rare gram get a key of their own that is longer than any gram:
    # nulls would all be sent to one task.
    lone = F.concat(F.lit("\0" * (GRAM + 1)), F.col("doc_id").cast("string"))
    rated = part.withColumn("gram", F.coalesce("rare", lone)).join(
        weights.select("gram", *[F.col(w).alias(f"r{w}") for w in names]), "gram", "left")
    sums = rated.groupBy("doc_id").agg(F.sum("c").alias("c"), *[
        F.sum(F.col(w) + F.col("c") * F.coalesce(F.col(f"r{w}"), F.lit(0.0))).alias(w) for w in names])

    model = totals.select(F.struct("V", "totals")).scalar()
    rates = [
        F.struct(
            (-F.round(F.col(w) - F.col("c") * F.ln(F.col("m.totals")[i] + F.col("m.V")), 6)).alias("cost"),
            F.lit(lang).alias("lang"),
        )
        for i, (w, lang) in enumerate(zip(names, langs))
    ]
    best = sums.withColumn("m", model).withColumn("best", F.array_min(F.array(*rates)))
    return best.select(
        "doc_id",
        F.when(F.col("c") > 0, F.col("best.lang")).alias("language"),
        F.when(F.col("c") > 0, -F.col("best.cost")).alias("score"),
    )


def undecided(scripts: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, text) of all parts (doc_id, index, original) of documents whose script does not tell the language."""
    told = scripts.filter("script IS NOT NULL").select("doc_id")
    return salted_lookup(parts, told, "doc_id", F.col("index"), "left_anti").select("doc_id", F.col("original").alias("text"))


def detect_language(scripts: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """(doc_id, language): the script's language, the classified one, else English."""
    if classified is None:
        return scripts.select("doc_id", F.coalesce("script", F.lit("en")).alias("language"))
    code = F.when(F.col("language").startswith("zh"), "zh").otherwise(F.col("language"))
    joined = scripts.join(classified.select("doc_id", "language"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("script", code, F.lit("en")).alias("language"))

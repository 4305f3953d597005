"""Language by hashed character 3-grams: a model of fixed size, counted and scored inside the rows.

Three neighbouring characters fall into one of BUCKETS buckets.  A language is an
array of bucket counts, whatever its texts hold, so training and scoring need no
shuffle by gram, and a gram that fills half of all texts is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The buckets and the weights of the three characters' code points.
BUCKETS = 16384
WEIGHTS = (1009, 61, 1)

LANGUAGES_AT_ONCE = 256  # whose weights a task holds
CHARS_AT_ONCE = 1 << 20


def bucketed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every 3-gram of the texts, and the number of its text."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    codes = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    if len(codes) < 3:
        return codes[:0], of[:0]
    hashed = (codes[:-2] * WEIGHTS[0] + codes[1:-1] * WEIGHTS[1] + codes[2:] * WEIGHTS[2]) % BUCKETS
    inside = of[:-2] == of[2:]
    return hashed[inside], of[:-2][inside]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a batch, some megabytes of text or one text at a time."""
    held, size, at = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        text = text.as_py()
        held.append(text)
        size += len(text or "")
        if size >= CHARS_AT_ONCE:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


def train(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) from (lang, text): counts per language, added up within each task first.

    Rows with a null lang are a language without a name and are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            lang, bucket, n = [], [], []
            for name, counts in held.items():
                met = np.flatnonzero(counts)
                lang += [name] * len(met)
                bucket.append(met)
                n.append(counts[met])
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate([*bucket, []]).astype(np.int32)),
                                               pa.array(np.concatenate([*n, []]).astype(np.int64))], ["lang", "bucket", "n"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in _slices(batch, "text"):
                buckets, of = bucketed(texts)
                for name in set(langs[at : at + len(texts)]):
                    mine = np.array([x == name for x in langs[at : at + len(texts)]])
                    held[name] = held.get(name, 0) + np.bincount(buckets[mine[of]], minlength=BUCKETS)
                if len(held) > LANGUAGES_AT_ONCE:
                    yield out()
                    held.clear()
        yield out()

    parts = labelled.filter("lang IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Languages in order of their names, and how much each bucket speaks for each."""

    languages: list[str]
    weights: np.ndarray  # languages x BUCKETS: ln(n + 1)
    norms: np.ndarray  # ln(all grams of the language + BUCKETS)

    @classmethod
    def of(cls, profile: DataFrame) -> Model:
        """From ``train``: BUCKETS numbers a language, whatever it was trained on."""
        rows = profile.toPandas()
        languages = sorted(rows["lang"].unique())
        counts = np.zeros((len(languages), BUCKETS))
        counts[np.searchsorted(languages, rows["lang"]) if languages else [], rows["bucket"]] = rows["n"]
        return cls(languages, np.log(counts + 1), np.log(counts.sum(axis=1) + BUCKETS))


def classify(texts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, score) of (doc_id, text), a document in any number of rows.

    score(lang) = sum over the grams of ln(n + 1) - grams * ln(all of lang + BUCKETS).
    The highest wins, on ties the first name; a document without three characters
    in a row of it has a null language and score.  Languages are scored by
    some hundred at a time, so there may be any number of them.
    """
    parts = [_costs(texts, model, low) for low in range(0, max(len(model.languages), 1), LANGUAGES_AT_ONCE)]
    costs = parts[0]
    for part in parts[1:]:
        costs = costs.unionByName(part)
    best = costs.groupBy("doc_id").agg(F.min(F.struct("cost", "lang")).alias("best"), F.max("c").alias("c"))
    told = F.col("c") > 0
    return best.select("doc_id", F.when(told, F.col("best.lang")).alias("language"), F.when(told, -F.col("best.cost")).alias("score"))


def _costs(texts: DataFrame, model: Model, low: int) -> DataFrame:
    """(doc_id, c, cost, lang): grams and rounded negative score of every document for some languages."""
    names = model.languages[low : low + LANGUAGES_AT_ONCE]
    weights, norms = model.weights[low : low + LANGUAGES_AT_ONCE], model.norms[low : low + LANGUAGES_AT_ONCE]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _slices(batch, "text"):
                buckets, of = bucketed(part)
                c = np.bincount(of, minlength=len(part))
                sums = np.stack([np.bincount(of, row[buckets], len(part)) for row in weights], 1) if len(names) else np.zeros((len(part), 0))
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(names))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(c.astype(np.int64)),
                                                  pa.ListArray.from_arrays(ends, pa.array(sums.ravel().astype(np.float64)))], ["doc_id", "c", "w"])

    slim = texts.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = slim.mapInArrow(score, f"doc_id {kind}, c long, w array<double>")
    if not names:
        return scored.select("doc_id", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("lang"))
    summed = scored.select("doc_id", "c", F.posexplode("w").alias("i", "w")).groupBy("doc_id", "i").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    norm, name = F.get(F.lit(norms.tolist()), F.col("i")), F.get(F.lit(names), F.col("i"))
    return summed.select("doc_id", "c", (-F.round(F.col("w") - F.col("c") * norm, 6)).alias("cost"), name.alias("lang"))

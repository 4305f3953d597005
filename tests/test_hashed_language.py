"""The hashed language model against plain Python, and script mapping with a large dictionary."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import replies
from pagewright.operators import hashed_language as hl

LABELLED = [("en", "the cat and the dog and the house"), ("fr", "le chat et le chien et la maison"), ("fr", None), ("en", ""), ("el", "η γάτα 𝄞 και"), (None, "no name")]
TEXTS = [("a", "the dog"), ("a", " and more"), ("b", "le chien"), ("c", ""), ("c", None), ("d", "ab"), ("e", "γάτα 𝄞 και"), ("f", None), (None, "the the")]


def grams(text):
    c = [ord(x) for x in text or ""]
    return [(c[i] * 1009 + c[i + 1] * 61 + c[i + 2]) % 16384 for i in range(len(c) - 2)]


def brute(labelled, texts):
    counts = {}
    for lang, text in labelled:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    found = {}
    for doc, text in texts:
        found.setdefault(doc, []).extend(grams(text))
    out = {}
    for doc, gs in found.items():
        rated = [(-round(sum(math.log(n[g] + 1) for g in gs) - len(gs) * math.log(sum(n.values()) + 16384), 6), lang) for lang, n in counts.items()]
        cost, lang = min(rated)
        out[doc] = (lang, -cost) if gs else (None, None)
    return out


@pytest.fixture(scope="module")
def model(spark):
    return hl.Model.of(hl.train(spark.createDataFrame(LABELLED, "lang string, text string").repartition(3)))


def scored(spark, texts, model):
    return {r.doc_id: (r.language, r.score) for r in hl.classify(spark.createDataFrame(texts, "doc_id string, text string").repartition(3), model).collect()}


def same(got, want):
    assert set(got) == set(want)
    for doc, (lang, score) in want.items():
        assert got[doc][0] == lang and (score is None) == (got[doc][1] is None)
        assert score is None or abs(got[doc][1] - score) < 1e-5


def test_scores_equal_brute_force(spark, model):
    assert model.languages == ["el", "en", "fr"]
    same(scored(spark, TEXTS, model), brute(LABELLED, TEXTS))


def test_slices_and_many_languages(spark, monkeypatch):
    rng = random.Random(1)
    labelled = [(f"l{i:03}", "".join(rng.choice("abcdefgh ") for _ in range(50))) for i in range(40)]
    texts = [(f"d{i % 9}", "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60)))) for i in range(60)]
    want = brute(labelled, texts)
    monkeypatch.setattr(hl, "LANGUAGES_AT_ONCE", 7)
    monkeypatch.setattr(hl, "CHARS_AT_ONCE", 100)
    model = hl.Model.of(hl.train(spark.createDataFrame(labelled, "lang string, text string")))
    assert len(model.languages) == 40
    same(scored(spark, texts, model), want)


def test_nothing_to_learn_or_score(spark, model):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert hl.classify(none, model).count() == 0
    empty = hl.Model.of(hl.train(spark.createDataFrame([], "lang string, text string")))
    assert scored(spark, [("a", "some text")], empty) == {"a": (None, None)}


def test_frequent_gram_is_no_hot_key(spark, model):
    """A text of one repeated gram: no shuffle holds more rows than documents and languages."""
    texts = spark.createDataFrame([(f"d{i}", "zzz" * 20_000) for i in range(20)], "doc_id string, text string")
    assert hl.classify(texts, model).select("language").distinct().count() == 1
    plan = hl.classify(texts, model)._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and plan.count("Exchange hashpartitioning") <= 2


def mapped_brute(text, characters, phrases):
    out, at = [], 0
    while at < len(text):
        for size in range(len(text) - at, 0, -1):
            if text[at : at + size] in phrases:
                out.append(phrases[text[at : at + size]])
                at += size
                break
        else:
            out.append(characters.get(text[at], text[at]))
            at += 1
    return "".join(out)


def test_phrases_equal_brute_force(spark):
    rng = random.Random(3)
    for _ in range(200):
        phrases = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): f"<{i}>" for i in range(rng.randrange(1, 9))}
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(30)))
        assert replies.phrase_mapper({"a": "A", "d": "D"}, phrases)(text) == mapped_brute(text, {"a": "A", "d": "D"}, phrases)
    rows = spark.createDataFrame([("是不是",), (None,), ("",)], "t string")
    got = [r.o for r in rows.select(replies.to_traditional(F.col("t"), {"不": "卜"}, {"是不": "X"}).alias("o")).collect()]
    assert got == ["X是", None, ""]


def test_large_dictionaries_cost_no_more():
    rng = np.random.default_rng(2)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    text = "".join(rng.choice(signs, 400_000))
    took = []
    for n in (100, 50_000):
        phrases = {"".join(rng.choice(signs, rng.integers(2, 5))): "".join(rng.choice(signs, 2)) for _ in range(n)}
        mapper = replies.phrase_mapper(dict(zip(signs, reversed(signs))), phrases)
        began = time.process_time()
        mapper(text)
        took.append(time.process_time() - began)
    assert took[1] <= 3 * took[0] + 0.2

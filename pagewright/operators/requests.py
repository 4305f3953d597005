"""Inference requests as tables; nothing here talks to a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..session import stage
from .frames import ordered_text
from .windows import windows

# Summaries that share one overview prompt.  A document with more of them is
# asked level by level: the answers about its parts are the next level's summaries.
SUMMARIES_PER_PROMPT = 1024


def _messages(system: Column, user: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", system), message("user", user))


def _request(df: DataFrame, kind: str, system: Column, user: Column, temperature: float, max_tokens: Column,
             index: str = "index", win_idx: Column | None = None) -> DataFrame:
    return df.select(
        "doc_id", F.col(index).cast("bigint").alias("index"),
        (F.lit(0) if win_idx is None else win_idx).cast("bigint").alias("win_idx"),
        F.lit(kind).alias("kind"), _messages(system, user).alias("messages"),
        F.lit(temperature).alias("temperature"), max_tokens.cast("int").alias("max_tokens"),
    )


def summary_requests(chunks: DataFrame, max_tokens: int = fv.SUMMARY_TOKENS) -> DataFrame:
    user = F.concat(F.lit(fv.SUMMARY_PREFIX), F.col("original"))
    return _request(chunks, "summary", F.lit(fv.SUMMARY_SYSTEM), user, fv.SUMMARY_TEMPERATURE, F.lit(max_tokens))


def overview_prompts(summaries: DataFrame, per_prompt: int = SUMMARIES_PER_PROMPT) -> DataFrame:
    """(doc_id, part, joined): the labelled summaries (doc_id, index, text) in order."""
    label = F.concat(F.lit("[段落 "), (F.col("index") + 1).cast("string"), F.lit("]\n"), F.col("text"))
    part = F.floor(F.col("index") / per_prompt)
    return summaries.withColumn("part", part).groupBy("doc_id", "part").agg(
        ordered_text(F.col("index"), label, "\n\n").alias("joined")
    )


def overview_requests(summaries: DataFrame, max_tokens: int = fv.OVERVIEW_TOKENS, per_prompt: int = SUMMARIES_PER_PROMPT) -> DataFrame:
    """One request per document or, for a very long one, per part, counted by ``index``."""
    user = F.concat(F.lit(fv.OVERVIEW_PREFIX), F.col("joined"))
    return _request(overview_prompts(summaries, per_prompt), "overview", F.lit(fv.OVERVIEW_SYSTEM), user,
                    fv.SUMMARY_TEMPERATURE, F.lit(max_tokens), index="part")


def overview_levels(summaries: DataFrame, ask: Callable[[DataFrame], DataFrame],
                    per_prompt: int = SUMMARIES_PER_PROMPT) -> tuple[DataFrame, DataFrame]:
    """(overviews, failures): one overview per document out of all of its summaries.

    ``ask`` answers requests.  While a document has several answers, these are
    summed up in turn.  A document of which any part fails is a failure
    (doc_id, error) and has no overview.  Every level is stored; there are as many
    as log(summaries) to the base ``per_prompt``.
    """
    overviews, failures, open_ = None, None, summaries
    while True:
        said = stage(ask(overview_requests(open_, per_prompt=per_prompt)), "overviews")
        failed = said.filter("error IS NOT NULL").groupBy("doc_id").agg(F.min_by("error", "index").alias("error"))
        good = said.join(failed.select("doc_id"), "doc_id", "left_anti")
        many = good.filter("index > 0").select("doc_id").distinct()
        whole = good.join(many, "doc_id", "left_anti")
        overviews = whole if overviews is None else overviews.unionByName(whole)
        failures = failed if failures is None else failures.unionByName(failed)
        if many.isEmpty():
            return overviews, failures
        open_ = good.join(many, "doc_id", "left_semi").select("doc_id", "index", "text")


def translation_windows(chunks: DataFrame, limit: int = fv.WINDOW_CHARS) -> DataFrame:
    """(doc_id, index, win_idx, window)."""
    return chunks.select("doc_id", "index", F.posexplode(windows(F.col("original"), limit)).alias("win_idx", "window"))


def translation_budget(window: Column) -> Column:
    return F.least(F.lit(fv.TRANSLATE_MAX_TOKENS), F.length(window) + fv.TRANSLATE_EXTRA_TOKENS)


def translation_requests(chunks: DataFrame, target_lang: str = "zho_Hant", limit: int = fv.WINDOW_CHARS) -> DataFrame:
    system = fv.TRANSLATE_SYSTEM.format(name=fv.LANGUAGE_NAMES.get(target_lang, target_lang))
    wins = translation_windows(chunks, limit)
    return _request(wins, "translation", F.lit(system), F.col("window"), fv.TRANSLATE_TEMPERATURE,
                    translation_budget(F.col("window")), win_idx=F.col("win_idx"))


def sentence_requests(chunks: DataFrame, source: Column) -> DataFrame:
    """One request per sentence, for sentence-level translators.

    ``win_idx`` numbers the sentences; ``source``, the code of the source language
    (see ``codes.source_code``), takes the place of the instructions.
    """
    split = F.posexplode(tx.sentences(F.col("original"))).alias("win_idx", "sentence")
    sents = chunks.select("doc_id", "index", source.alias("source"), split)
    return _request(sents, "translation", F.col("source"), F.col("sentence"), 0.0, F.lit(0), win_idx=F.col("win_idx"))


def sample_requests(chunks: DataFrame, target_lang: str = "zho_Hant",
                    chars: int = fv.SCRIPT_TRANSLATE_CHARS) -> DataFrame:
    """The command-line variant: the head of each chunk as a single request."""
    system = fv.TRANSLATE_SYSTEM.format(name=fv.LANGUAGE_NAMES.get(target_lang, target_lang))
    heads = chunks.withColumn("sample", F.left("original", F.lit(chars)))
    budget = F.least(F.lit(fv.TRANSLATE_MAX_TOKENS),
                     F.floor(F.length("sample") / 2) + fv.SCRIPT_TRANSLATE_EXTRA_TOKENS)
    return _request(heads, "translation", F.lit(system), F.col("sample"), fv.TRANSLATE_TEMPERATURE, budget)

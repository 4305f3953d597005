"""The whole analysis of a collection: pages in, result tables out.

Each step that is dear or read more than once is written to the shared scratch
folder and read back, so model calls in particular are never repeated by a
later step or a lost executor.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, check_features
from ..functions import replies
from ..functions.codes import already_target, source_code
from ..operators import assemble as asm
from ..operators import inference as inf
from ..operators import keywords as kw
from ..operators import hashed_language as hl
from ..operators import language as lg
from ..operators import pages as pg
from ..operators import progress as pr
from ..operators import requests as rq
from ..operators.packing import chunk_pages
from ..operators.joins import salted_lookup
from ..session import stage


@dataclass(frozen=True)
class Analysis:
    chunks: DataFrame
    languages: DataFrame
    responses: DataFrame | None
    segments: DataFrame
    keywords: DataFrame | None
    wordcloud: DataFrame | None
    results: DataFrame
    payloads: DataFrame
    stored_segments: DataFrame
    report: DataFrame | None
    events: DataFrame


def _failures(responses: DataFrame) -> DataFrame:
    """The first failed call of each document."""
    first = F.struct("index", F.col("kind") != "summary", "win_idx")
    return responses.filter("error is not null").groupBy("doc_id").agg(
        F.min_by("error", first).alias("error"), F.min("index").alias("failed_after"))


def _overview_failures(failed: DataFrame, responses: DataFrame) -> DataFrame:
    """Documents whose overview failed, after all of their segments."""
    segments = responses.filter("kind = 'summary'").groupBy("doc_id").agg(F.count("*").alias("failed_after"))
    return failed.join(segments, "doc_id")


def analyze(pages: DataFrame, config: Config, client_factory: Callable[[], inf.Client],
            features: str, ocr_pages: DataFrame | None = None, profile: DataFrame | hl.Model | None = None,
            fix_script: Callable | None = None, tasks: int | None = None,
            translators: Mapping[str, Callable[[], inf.BatchTranslator]] | None = None,
            unread: DataFrame | None = None) -> Analysis:
    """Analyse every document of ``pages`` (doc_id, page_no, text).

    ``unread`` (doc_id, error; see ``uploads.without_pages``) are documents
    without pages, which get their events too.
    ``profile`` is a stored 3-gram profile for languages told apart by their
    letters only.  ``fix_script`` (Column -> Column) is applied to model output
    when the target is Traditional Chinese.  ``tasks`` is the number of tasks
    the model calls are dealt out to.  ``translators`` names factories of
    sentence translators for settings other than the window translator.
    """
    wanted = check_features(features)
    do_summary, do_translate = "summary" in wanted, "translate" in wanted
    do_cloud, do_report = "wordcloud" in wanted, "report" in wanted
    fixed = fix_script if fix_script is not None and config.use_traditional else (lambda c: c)

    merged = pg.merge_ocr(pages, ocr_pages if config.ocr else None)
    counts = stage(pg.page_counts(merged), "page-counts")
    kept = stage(pg.meaningful_pages(merged), "kept")
    chunks = stage(chunk_pages(kept, config.max_chunk_chars), "chunks")

    scripts = lg.document_scripts(chunks.select("doc_id", F.col("original").alias("text")))
    classified = None
    if profile is not None:
        classify = hl.classify if isinstance(profile, hl.Model) else lg.classify
        classified = classify(lg.undecided(scripts, chunks), profile)
    languages = stage(lg.detect_language(scripts, classified), "languages")

    replied = []
    if do_summary:
        replied.append(inf.run_inference(rq.summary_requests(chunks), client_factory, tasks))
    if do_translate:
        done = languages.filter(already_target(F.col("language"), config.target_lang)).select("doc_id")
        foreign = salted_lookup(chunks, done, "doc_id", F.col("index"), "left_anti")
        if config.by_windows:
            asked = rq.translation_requests(foreign, config.target_lang)
            replied.append(inf.run_inference(asked, client_factory, tasks))
        else:
            told = salted_lookup(foreign, languages, "doc_id", F.col("index"))
            asked = rq.sentence_requests(told, source_code(F.col("language"), config.src_lang))
            replied.append(inf.run_batches(asked, (translators or {})[config.translator], tasks=tasks))
    responses = None
    if replied:
        every = reduce(DataFrame.unionByName, replied)
        responses = stage(every.withColumn("text", fixed(F.col("text"))), "responses")

    overviews, summaries, translations = None, None, None
    failures = _failures(responses) if replied else None
    if do_summary:
        summaries = responses.filter("kind = 'summary'").select("doc_id", "index", "text")
        # A failed document ends there: it is asked for no overview and has no result.
        good = salted_lookup(summaries, failures.select("doc_id"), "doc_id", F.col("index"), "left_anti")
        said, unsaid = rq.overview_levels(good, lambda asked: inf.run_inference(asked, client_factory, tasks))
        overviews = said.select("doc_id", replies.parse_overview(fixed(F.col("text"))).alias("global_summary"))
        failures = failures.unionByName(_overview_failures(unsaid, responses))
    if do_translate:
        translations = inf.merge_translations(responses, "\n" if config.by_windows else " ").select("doc_id", "index", "text")

    segments = stage(asm.assemble_segments(chunks, summaries, translations), "segments")
    keywords = arrays = cloud = None
    if do_cloud:
        texts = kept.select("doc_id", F.col("page_no").alias("ord"), "text")
        keywords = stage(kw.extract_keywords(texts, languages), "keywords")
        arrays, cloud = kw.keyword_arrays(keywords), kw.wordcloud_terms(keywords)
    chunk_counts = stage(pg.chunk_counts(chunks), "chunk-counts")
    results = asm.document_results(counts, chunk_counts, languages, arrays, overviews, reports=do_report)
    if failures is not None:
        failures = stage(failures, "failures")
        results = results.join(failures.select("doc_id"), "doc_id", "left_anti")
        finished = salted_lookup(segments, failures.select("doc_id"), "doc_id", F.col("index"), "left_anti")
    else:
        finished = segments
    results = stage(results, "results")

    state = counts.join(chunk_counts, "doc_id", "left").join(languages, "doc_id", "left")
    if failures is None:
        state = state.withColumns({"error": F.lit(None).cast("string"), "failed_after": F.lit(None).cast("bigint")})
    else:
        state = state.join(failures, "doc_id", "left")
    if unread is not None:
        gone = unread.select("doc_id", "error", F.when(F.col("error").isNotNull(), -1).cast("bigint").alias("failed_after"),
                             F.lit(0).cast("bigint").alias("total_pages"), F.lit("").alias("language"))
        state = state.unionByName(gone, allowMissingColumns=True)
    skip = already_target(F.col("language"), config.target_lang) if do_translate else F.lit(False)
    state = state.withColumns({
        "n_chunks": F.coalesce("n_chunks", F.lit(0)), "skip_translation": skip, "do_summary": F.lit(do_summary),
        "do_wordcloud": F.lit(do_cloud), "do_report": F.lit(do_report),
    })
    return Analysis(
        chunks=chunks, languages=languages, responses=responses, segments=segments, keywords=keywords, wordcloud=cloud,
        results=results, payloads=asm.result_json(results), stored_segments=finished,
        report=asm.report_rows(results, finished) if do_report else None, events=pr.progress_events(state),
    )

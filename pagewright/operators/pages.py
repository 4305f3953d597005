"""Page tables: OCR merge, classification, cleaning, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from .frames import let, ordered_text


def merge_ocr(pages: DataFrame, ocr_pages: DataFrame | None, min_chars: int = fv.OCR_MIN_CHARS) -> DataFrame:
    """Take the OCR text of a nearly empty page when it is strictly longer.

    ``ocr_pages`` is (doc_id, page_no, ocr_text), one row per page.  Only pages
    under ``min_chars`` take part in the join; the bulk of the text stays put.
    """
    stripped = pages.withColumn("text", tx.strip(F.col("text")))
    if ocr_pages is None:
        return stripped
    keys = ["doc_id", "page_no"]
    size = F.length("text")
    long = stripped.filter(size >= min_chars)
    short = stripped.filter(size < min_chars).join(
        ocr_pages.select(*keys, F.coalesce("ocr_text", F.lit("")).alias("_ocr")), keys, "left")
    text = F.when(F.length("_ocr") > size, F.col("_ocr")).otherwise(F.col("text"))
    return long.unionByName(short.withColumn("text", text).drop("_ocr"))


def ocr_candidates(pages: DataFrame, min_chars: int = fv.OCR_MIN_CHARS) -> DataFrame:
    """The pages worth sending to an OCR engine."""
    return pages.filter(F.length(tx.strip(F.col("text"))) < min_chars)


def assemble_ocr(lines: DataFrame) -> DataFrame:
    """OCR lines of each page, top to bottom, as one text.

    A group is one page image; lines without text are dropped.
    """
    return (
        lines.filter(F.col("text").isNotNull())
        .groupBy("doc_id", "page_no")
        .agg(tx.strip(ordered_text(F.col("line_no"), F.col("text"), "\n")).alias("ocr_text"))
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """Add ``meaningful`` and ``clean`` (the cleaned text) to every page."""
    body = F.col("body")
    staged = let(pages, body=tx.strip(F.col("text")))
    staged = let(
        staged,
        is_cjk=tx.cjk_ratio(body) >= fv.CJK_PAGE_RATIO,
        content=tx.content_lines(body),
        skip=tx.has_skip_heading(body),
    )
    staged = let(staged, prose=F.filter("content", tx.is_sentence_like))
    size = F.length(body)
    share = F.length(F.array_join("prose", " "))

    def by_script(cjk: float, other: float) -> Column:
        return F.when(F.col("is_cjk"), F.lit(cjk)).otherwise(F.lit(other))

    meaningful = (
        (size >= by_script(fv.MIN_PAGE_CHARS_CJK, fv.MIN_PAGE_CHARS))
        & ~F.col("skip")
        & (F.size("prose") >= fv.MIN_PROSE_LINES)
        & (share >= size * by_script(fv.MIN_PROSE_SHARE_CJK, fv.MIN_PROSE_SHARE))
    )
    kept = F.when(F.col("is_cjk"), F.col("content")).otherwise(F.col("prose"))
    return let(staged, meaningful=meaningful, clean=F.array_join(kept, "\n")).drop(
        "body", "is_cjk", "content", "skip", "prose"
    )


def meaningful_pages(pages: DataFrame) -> DataFrame:
    """Cleaned text and its ``size`` for the meaningful pages; pages empty after cleaning go."""
    kept = classify_pages(pages).filter("meaningful and clean != ''")
    return kept.withColumn("text", F.col("clean")).withColumn("size", F.length("clean")).drop("clean", "meaningful")


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages and characters per document."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"), F.sum(F.length("text")).alias("total_chars")
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("original")).alias("chunk_chars")
    )


def first_chunks(chunks: DataFrame, max_chunks: int = 0) -> DataFrame:
    """The command-line variant's ``--max-chunks``; 0 keeps all."""
    return chunks.filter(F.col("index") < max_chunks) if max_chunks else chunks

"""Uploads: scan, validate, deduplicate, extract pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import digest, upload_status

Extractor = Callable[[bytes], list[str]]

_READ_COLUMNS = ["doc_id", "page_no", "text", "error"]
_FLUSH_CHARS = 16_000_000  # text held back in a task before it is handed on


def scan_uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(filename, length, content) of every file below ``path``.

    Spark's file scan passes over files of no bytes; uploads that come as table
    rows keep theirs, and ``validate`` rejects them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return with_filename(files.load(path))


def with_filename(files: DataFrame) -> DataFrame:
    return files.select(F.substring_index("path", "/", -1).alias("filename"), "length", "content")


def validate(uploads: DataFrame, max_bytes: int) -> DataFrame:
    """Add ``reject``: 400, 413, 415 or null."""
    return uploads.withColumn("reject", upload_status(F.col("length"), F.col("filename"), max_bytes))


def with_digest(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("digest", digest(F.col("content")))


def first_copies(uploads: DataFrame, order: str) -> DataFrame:
    """(digest, order, n_copies): the first copy of every distinct content.

    Only ids are shuffled, and a content with very many copies is reduced in the
    map tasks.
    """
    return uploads.groupBy("digest").agg(F.min(order).alias(order), F.count("*").alias("n_copies"))


def text_pages(content: bytes) -> list[str]:
    """Extractor for plain text with form feeds between pages."""
    return content.decode("utf-8", "replace").split("\f")


def read_documents(uploads: DataFrame, factory: Callable[[], Extractor]) -> DataFrame:
    """(doc_id, page_no, text, error) by the caller's extractor, one instance per task.

    ``uploads`` has doc_id and content.  Pages keep their order, blank pages
    stay as empty strings.  A document that cannot be read, or that has no pages,
    is one row without page_no, with the extractor's error if there was one.
    Readings that several steps use should be stored.
    """

    def pages_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = factory()
        rows: list[tuple[str, int | None, str | None, str | None]] = []
        chars = 0
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                error = None
                try:
                    texts = [t.strip() for t in extract(bytes(content))]
                except Exception as problem:
                    texts, error = [], str(problem) or type(problem).__name__
                for no, text in enumerate(texts):
                    rows.append((doc_id, no, text, None))
                    chars += len(text)
                    if chars > _FLUSH_CHARS:
                        yield frame(rows)
                        rows, chars = [], 0
                if not texts:
                    rows.append((doc_id, None, None, error))
        if rows:
            yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_READ_COLUMNS).astype({"page_no": "Int64"})

    return uploads.select("doc_id", "content").mapInPandas(pages_of, "doc_id string, page_no long, text string, error string")


def pages_read(readings: DataFrame) -> DataFrame:
    """The pages (doc_id, page_no, text) among ``read_documents``' rows."""
    return readings.filter("page_no IS NOT NULL").drop("error")


def without_pages(readings: DataFrame) -> DataFrame:
    """(doc_id, error) of the documents that gave no page; error is null where there was none."""
    return readings.filter("page_no IS NULL").select("doc_id", "error")


def extract_pages(uploads: DataFrame, factory: Callable[[], Extractor]) -> DataFrame:
    """(doc_id, page_no, text): the pages of all documents that can be read."""
    return pages_read(read_documents(uploads, factory))


def split_pages(texts: DataFrame) -> DataFrame:
    """Text documents (doc_id, text) with form feeds -> pages, without leaving the JVM."""
    from ..functions.text import strip

    return texts.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page_no", "text")).select(
        "doc_id", F.col("page_no").cast("bigint").alias("page_no"), strip(F.col("text")).alias("text")
    )

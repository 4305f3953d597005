"""WARC: archives of page captures, written by Spark's text writer, read and joined again.

A page becomes a transaction of three records: response (or revisit), request
and metadata, the latter two naming the first as concurrent.  An archive is a
plain WARC/1.1 file: the writer ends each row with the newline that a record's
closing CRLF CRLF needs anyway.  Archives are cut by bytes: pages of a size class
are written with as many to a file as keep it near 256 MB.  Reading goes by
Content-Length, so payloads may hold any text; damage gives rows with an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

REVISIT_BYTES = 1000
# Page bytes up to which so many pages go into one archive; beyond the last each page has its own.
ARCHIVES = ((2**16, 4096), (2**22, 64), (2**63 - 1, 1))
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _lines(*parts) -> Column:
    """Header lines, each ended by CRLF; a line with a null part is left out."""
    return F.concat(*[F.coalesce(F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in line], F.lit(CRLF)), F.lit(""))
                      for line in parts])


def _record(headers: Column, block: Column) -> Column:
    """One record without its last newline."""
    return F.concat(headers, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF + "\r"))


def _one_line(text: Column) -> Column:
    """Header values can't hold line ends."""
    return F.regexp_replace(text, "[\\r\\n]+", " ")


def capture_id(page_id: Column, digest: Column) -> Column:
    """The id of the record of a page's payload: a UUID urn from both."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """Add payload, digest and refers_to (page_id) to ``pages`` (page_id, url, html).

    Of the pages with one payload of at least 1,000 bytes, the largest page_id is
    the response and the others revisit it.  The largest ids come from an
    aggregate that combines in the map tasks; only payloads met more than once
    are kept of it, so the join back is a broadcast where that table is small and
    a shuffle that splits hot digests where it is not.
    """
    full = pages.withColumn("payload", F.coalesce("html", F.lit(""))).drop("html")
    full = full.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= REVISIT_BYTES
    shared = full.filter(large).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("winner"))
    winners = stage(shared.filter("n > 1").select("digest", "winner"), "winners")
    joined = full.join(winners, "digest", "left")
    revisits = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return joined.withColumn("refers_to", F.when(revisits, F.col("winner"))).drop("winner")


def write_archives(pages: DataFrame, path: str, archives: tuple[tuple[int, int], ...] = ARCHIVES) -> None:
    """Write the transactions of ``pages`` (page_id, url, html) as WARC files in folders below ``path``, one a size class.

    ``archives`` has the classes as (most bytes of html and thrice the url, pages
    a file).  Only classes that the largest page reaches are written; each reads
    its own pages, so that a page is digested once.  Null html is an empty
    payload, a null url an empty target, a null page_id is left out of the
    headers.  Further columns are left out.  No pages give archives of no records.
    """
    rows = pages.select("page_id", "url", "html")
    size = (F.coalesce(F.octet_length("html"), F.lit(0)) + 3 * F.coalesce(F.octet_length("url"), F.lit(0))).cast("long")
    largest = rows.agg(F.coalesce(F.max(size), F.lit(0))).first()[0]
    text = _transactions(with_revisits(rows.withColumn("_bytes", size)))
    above = -1
    for most, each in archives:
        if above < largest:
            written = text.filter((F.col("_bytes") > above) & (F.col("_bytes") <= most)).select("value")
            written.write.option("maxRecordsPerFile", each).option("lineSep", "\n").text(f"{path}/upto={most}")
        above = most


def _transactions(rows: DataFrame) -> DataFrame:
    """``value``: response or revisit, request and metadata of each row of ``with_revisits``, beside its _bytes."""
    me = capture_id(F.col("page_id"), F.col("digest"))
    url = _one_line(F.coalesce("url", F.lit("")))
    page = F.col("page_id").cast("string")
    date = ("WARC-Date: 1970-01-01T00:00:00Z",)
    size = F.octet_length("payload").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(CRLF + CRLF))
    is_revisit = F.col("refers_to").isNotNull()
    kind = F.when(is_revisit, "revisit").otherwise("response")
    target = capture_id(F.col("refers_to"), F.col("digest"))
    main = _record(_lines(
        (VERSION,), ("WARC-Type: ", kind), ("WARC-Record-ID: ", me), date, ("WARC-Target-URI: ", url), ("WARC-Page-ID: ", page),
        ("WARC-Payload-Digest: sha1:", F.col("digest")), ("WARC-Payload-Length: ", size),
        ("WARC-Profile: ", F.when(is_revisit, PROFILE)), ("WARC-Refers-To: ", F.when(is_revisit, target)),
        ("WARC-Refers-To-Page: ", F.col("refers_to").cast("string")), ("Content-Type: application/http; msgtype=response",)),
        F.concat(head, F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))))

    def side(name: str, kind_of: str, block: Column) -> Column:
        own = capture_id(F.concat_ws("|", F.lit(name), F.coalesce(page, F.lit("null"))), F.col("digest"))
        return _record(_lines((VERSION,), (f"WARC-Type: {name}",), ("WARC-Record-ID: ", own), date, ("WARC-Target-URI: ", url),
                              ("WARC-Concurrent-To: ", me), (f"Content-Type: {kind_of}",)), block)

    request = side("request", "application/http; msgtype=request",
                   F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\nUser-Agent: pagewright\r\n\r\n")))
    metadata = side("metadata", "application/warc-fields", F.concat(F.lit("payloadBytes: "), size, F.lit(CRLF)))
    return rows.select("_bytes", F.concat_ws("\n", main, request, metadata).alias("value"))


RECORDS = ("type string, record_id string, concurrent_to string, refers_to string, uri string, page_id long, refers_to_page long, "
           "stated_digest string, stated_bytes long, payload binary, error string")
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_ROWS_HELD, _BYTES_HELD = 1000, 2**24


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files below ``path``, plain or of gzip members; payloads are without HTTP headers.

    ``error`` is null for sound records.  A record without an HTTP header where
    one is announced keeps its whole block, one that ends with the file what is
    there of it; a stretch of bytes that is no record, or whose length is not
    told, is a row without a type that holds those bytes, and reading goes on at
    the next record that starts a line.  What is left of a damaged gzip file is
    such a row too.  Header values that should be numbers and are not are null.
    An empty file has no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for row in _rows(content):
                    rows.append(row)
                    held += len(row[-2])
                    if len(rows) == _ROWS_HELD or held > _BYTES_HELD:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)

    return files.mapInPandas(run, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"page_id": "Int64", "refers_to_page": "Int64", "stated_bytes": "Int64"})


def _rows(content: bytes) -> Iterator[tuple]:
    """A row for each record of an archive."""
    if content[:2] == b"\x1f\x8b":
        content, left = _unzipped(content)
        if left:
            yield _row({}, left, "damaged gzip member")
    for headers, start, end, error in _records(content):
        payload = content[start:end]
        if "application/http" in headers.get("content-type", ""):
            _, found, body = payload.partition(b"\r\n\r\n")
            payload, error = (body, error) if found else (payload, error or "no HTTP header")
        yield _row(headers, payload, error)


def _unzipped(content: bytes) -> tuple[bytes, bytes]:
    """The bytes of all gzip members, and what is left from the first damaged one on."""
    parts = []
    while content:
        member = zlib.decompressobj(31)
        try:
            part = member.decompress(content)
        except zlib.error:
            break
        if not member.eof:
            break
        parts.append(part)
        content = member.unused_data
    return b"".join(parts), content


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def _row(h: dict[str, str], payload: bytes, error: str | None) -> tuple:
    digest = h.get("warc-payload-digest")
    return (h.get("warc-type"), h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"),
            _number(h.get("warc-page-id")), _number(h.get("warc-refers-to-page")), digest and digest.removeprefix("sha1:"),
            _number(h.get("warc-payload-length")), payload, error)


_START = re.compile(rb"\nWARC/1\.[0-9]\r\n")


def _records(content: bytes) -> Iterator[tuple[dict[str, str], int, int, str | None]]:
    """Headers, block range and error of each record of an archive, and ranges that are none."""
    at = 0
    while at < len(content):
        head_end = content.find(b"\r\n\r\n", at) if content.startswith(b"WARC/", at) else -1
        lines = content[at:head_end].decode("utf-8", "replace").split(CRLF) if head_end >= 0 else []
        headers = {m[1].lower(): m[2] for m in (re.match(r"([^:]+):\s*(.*)", x) for x in lines[1:]) if m}
        length = _number(headers.get("content-length"))
        if length is None or length < 0:
            met = _START.search(content, at)
            end = met.start() + 1 if met else len(content)
            yield {}, at, end, "no record"
            at = end
            continue
        start = head_end + 4
        end = start + length
        yield headers, start, min(end, len(content)), "cut off" if end > len(content) else None
        at = end + 4 if content[end : end + 4] == b"\r\n\r\n" else end


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One row per capture: its response or revisit, with its requests and metadata nested.

    A request or metadata record belongs to the capture whose record id it names
    as concurrent.  The sides are gathered per named id and joined to the main
    records, so payloads of responses are moved once and only if the caller still
    has the column.  Records that name no known capture make a row with a null
    capture, those that name none a row each.  A capture written twice is two rows
    with the same sides.  Records without a type are in no transaction.
    """
    mains = records.filter(F.col("type").isin("response", "revisit", "resource"))
    sides = records.filter(~F.col("type").isin("response", "revisit", "resource"))
    item = F.struct(*[c for c in records.columns if c not in ("concurrent_to", "refers_to", "refers_to_page")])
    is_request = F.col("type") == "request"
    gathered = sides.filter("concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.collect_list(F.when(is_request, item)).alias("requests"), F.collect_list(F.when(~is_request, item)).alias("metadata"))
    alone = sides.filter("concurrent_to IS NULL").select(
        F.lit(None).cast("string").alias("capture_id"), F.array_compact(F.array(F.when(is_request, item))).alias("requests"),
        F.array_compact(F.array(F.when(~is_request, item))).alias("metadata"))
    main = mains.select(F.col("record_id").alias("capture_id"), F.struct(*[c for c in records.columns if c != "concurrent_to"]).alias("capture"))
    return main.join(gathered, "capture_id", "full").unionByName(alone, allowMissingColumns=True)

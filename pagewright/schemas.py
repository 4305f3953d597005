"""Explicit schemas of every table that crosses a boundary."""

from pyspark.sql import types as T


def _row(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

PAGES = _row(("doc_id", _s), ("page_no", _l), ("text", _s))
OCR_LINES = _row(("doc_id", _s), ("page_no", _l), ("line_no", _l), ("text", _s), ("score", _d))
SEGMENT = _row(("index", _l), ("original", _s), ("translated", _s), ("summary", _s))
OVERVIEW = _row(("conclusion", _s), ("data", _s), ("risk", _s), ("action", _s), ("raw", _s))
RESULT = _row(
    ("doc_id", _s), ("language", _s), ("total_pages", _l), ("segments", T.ArrayType(SEGMENT)),
    ("global_summary", OVERVIEW), ("keywords", T.ArrayType(_s)),
    ("wordcloud_image_url", _s), ("report_pdf_url", _s),
)
EVENT = _row(("doc_id", _s), ("seq", _l), ("type", _s), ("progress", _i), ("message", _s), ("data", _s))
HISTORY = _row(
    ("doc_id", _s), ("filename", _s), ("created_at", _d), ("status", _s),
    ("total_pages", _l), ("has_report", _i), ("result", _s), ("error", _s),
)
CACHE = _row(("key", _s), ("result", _s), ("created_at", _d))
MESSAGES = T.ArrayType(_row(("role", _s), ("content", _s)))
REQUESTS = _row(
    ("doc_id", _s), ("index", _l), ("win_idx", _l), ("kind", _s), ("messages", MESSAGES),
    ("temperature", _d), ("max_tokens", _i),
)
RESPONSES = _row(
    ("doc_id", _s), ("index", _l), ("win_idx", _l), ("kind", _s), ("text", _s),
    ("elapsed", _d), ("completion_tokens", _l), ("error", _s),
)
REPLIES = _row(
    ("ask", _s), ("kind", _s), ("text", _s), ("elapsed", _d), ("completion_tokens", _l), ("error", _s), ("at", T.TimestampType()),
)
COMPLETION = T.StructType([
    T.StructField("choices", T.ArrayType(_row(("message", _row(("content", _s)))))),
    T.StructField("usage", _row(("completion_tokens", _l))),
])

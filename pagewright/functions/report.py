"""Expressions of the side-by-side report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import bind, strip


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{fv.SPACE}]+$", "")


def _last_index(text: Column, needle: str) -> Column:
    """0-based position of the last occurrence, -1 when there is none."""
    from_end = F.instr(F.reverse(text), needle[::-1])
    return F.when(from_end > 0, F.length(text) - from_end - len(needle) + 1).otherwise(-1)


def clip_sentence(text: Column, limit: int = fv.CLIP_CHARS) -> Column:
    """Cut at the last sentence end in the second half, trying the stops in fixed order."""
    def cut(head: Column) -> Column:
        out = F.when(F.lit(False), head)
        for stop in fv.CLIP_STOPS:
            at = _last_index(head, stop)
            out = out.when(at > limit * 0.5, F.concat(_rstrip(F.left(head, at + 1)), F.lit(" …")))
        return out.otherwise(F.concat(_rstrip(head), F.lit(" …")))

    def clip(body: Column) -> Column:
        return F.when(F.length(body) <= limit, body).otherwise(bind(F.left(body, F.lit(limit)), cut))

    return bind(strip(F.coalesce(text, F.lit(""))), clip)


def markup(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def default_view(summary: Column, translated: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(summary, F.lit("")), F.nullif(translated, F.lit("")), original)

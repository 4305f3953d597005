"""Expressions over model replies: cleaning, section parsing, script mapping."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..schemas import COMPLETION
from .codes import lookup
from .text import bind, lines, strip

ROWS_AT_ONCE = 64  # texts that a worker holds as Python strings


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?isu)<think>.*?</think>", ""))


def heading_part(line: Column) -> Column:
    """Which of the four parts a line is the heading of, null for other lines."""
    noise = fv.HEADING_NOISE.replace(r"\s", fv.SPACE)
    return lookup(fv.HEADINGS, F.regexp_replace(line, noise, ""))


def parse_overview(raw: Column) -> Column:
    """Cut a reply into its four parts.

    One row holds one reply, so the cut is array work inside the row: find the
    heading lines, take the lines up to the next one, keep the first non-empty
    body of every part.
    """
    marked = F.transform(lines(raw), lambda s: F.struct(s.alias("line"), heading_part(s).alias("part")))
    none = F.lit(None).cast("int")

    def cut(rows: Column) -> Column:
        at = F.transform(rows, lambda r, i: F.when(r["part"].isNotNull(), i).otherwise(none))
        return bind(F.filter(at, lambda i: i.isNotNull()), lambda heads: bodies(rows, heads))

    def bodies(rows: Column, heads: Column) -> Column:
        def section(i: Column, nth: Column) -> Column:
            stop = F.coalesce(F.get(heads, nth + 1), F.size(rows))
            body = F.transform(F.slice(rows, i + 2, stop - i - 1), lambda r: r["line"])
            return F.struct(F.get(rows, i)["part"].alias("part"),
                            strip(F.array_join(body, "\n")).alias("body"))

        return F.transform(heads, section)

    def pick(sections: Column) -> Column:
        def first_body(part: str) -> Column:
            hit = F.filter(sections, lambda s: (s["part"] == part) & (s["body"] != ""))
            return F.coalesce(F.get(hit, F.lit(0))["body"], F.lit("")).alias(part)

        return F.struct(*[first_body(p) for p in fv.PARTS], raw.alias("raw"))

    return bind(bind(marked, cut), pick)


def phrase_mapper(characters: dict[str, str], phrases: dict[str, str]):
    """A function that maps a text in one pass from the left.

    Phrases are found by their first two characters, which give the lengths to
    try, the longest first; so the time does not depend on their number.
    """
    table = str.maketrans({**characters, **{p: to for p, to in phrases.items() if len(p) == 1}})
    longer = {p: to for p, to in phrases.items() if len(p) > 1}
    lengths: dict[str, list[int]] = {}
    for head, size in sorted({(p[:2], len(p)) for p in longer}, key=lambda x: -x[1]):
        lengths.setdefault(head, []).append(size)

    def convert(text: str) -> str:
        out, begin, at = [], 0, 0
        while at < len(text) - 1:
            step = 1
            for size in lengths.get(text[at : at + 2], ()):
                found = longer.get(text[at : at + size])
                if found is not None:
                    out += [text[begin:at].translate(table), found]
                    step, begin = size, at + size
                    break
            at += step
        return "".join([*out, text[begin:].translate(table)])

    return convert


def to_traditional(text: Column, characters: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """Map simplified to traditional script with the caller's table.

    One pass from the left: at each place the longest phrase that starts there is
    taken, else the character; each piece is looked up once, so what a phrase
    gives is not mapped again.  Characters alone are mapped without Python workers.
    The table goes to every worker once, as a part of the plan.
    """
    if not phrases:
        return F.translate(text, "".join(characters), "".join(characters.values()))
    mapper = phrase_mapper(characters, phrases)

    @F.arrow_udf("string")
    def mapped(texts: pa.Array) -> pa.Array:
        return map_slices(texts, mapper)

    return mapped(text)


def map_slices(texts: pa.Array, mapper: Callable[[str], str], rows: int = ROWS_AT_ONCE) -> pa.Array:
    """``mapper`` of every text.  Python's strings of a few rows at a time are held, not those of a whole batch."""
    parts = [pa.array([], pa.string())]
    for low in range(0, len(texts), rows):
        parts.append(pa.array([None if t is None else mapper(t) for t in texts.slice(low, rows).to_pylist()], pa.string()))
    return pa.concat_arrays(parts)


def completion(body: Column) -> Column:
    """Text and token count of a chat completion given as JSON."""
    parsed = F.from_json(body, COMPLETION)
    return F.struct(
        strip_think(F.get(parsed["choices"], F.lit(0))["message"]["content"]).alias("text"),
        F.coalesce(parsed["usage"]["completion_tokens"], F.lit(0)).alias("completion_tokens"),
    )


def tokens_per_second(tokens: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, tokens / elapsed).otherwise(0.0)

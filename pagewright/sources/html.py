"""Web pages to page text, as regex expressions over the whole page."""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

DROPPED_ELEMENTS = ("script", "style", "nav", "footer")
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|title|head|body|html"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# The usual names first: a map is searched from its front.
COMMON = ("amp", "nbsp", "quot", "lt", "gt", "copy", "middot", "mdash", "ndash", "rsquo", "lsquo", "ldquo", "rdquo", "hellip", "bull")
NAMED = {n: html5[n + ";"] for n in COMMON} | {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
NAMED = {n: c.replace("\xa0", " ") for n, c in NAMED.items()}
# Numbers that stand for other characters than their own.
RENUMBERED = {n: unescape(f"&#{n};") for n in range(0x80, 0xA0)} | {0xA0: " "}


def decode_entities(text: Column) -> Column:
    """Named and numeric entities to characters, in one pass, so what comes out is not decoded again.

    Unknown names stay as they are; numbers of no character give U+FFFD; a
    no-break space becomes a space.  Only entities with a semicolon count.
    """
    pieces = F.regexp_extract_all(text, F.lit(ENTITY + "|[^&]+|&"), F.lit(0))
    plain = ~F.contains(text, F.lit("&"))
    return F.when(plain, text).otherwise(F.array_join(F.transform(pieces, _decoded), ""))


def _decoded(piece: Column) -> Column:
    # Two strings that the optimizer folds to a map once, rather than thousands of literals.
    named = F.map_from_arrays(*[F.split(F.lit(" ".join(x)), " ") for x in (NAMED, [c.replace(" ", "\xa0") for c in NAMED.values()])])
    renumbered = F.create_map(*[F.lit(x) for pair in RENUMBERED.items() for x in pair])
    number = piece.startswith("&#")
    base16 = F.lower(F.substring(piece, 3, 1)) == "x"
    digits = F.regexp_replace(piece, "[&#xX;]", "")
    code = F.when(base16, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    char = F.when(valid, F.coalesce(F.try_element_at(renumbered, code), own)).otherwise("\ufffd")
    known = F.try_element_at(named, F.substring_index(F.substring(piece, 2, 40), ";", 1))
    name = F.coalesce(F.translate(known, "\xa0", " "), piece)
    return F.when(~piece.startswith("&") | (piece == "&"), piece).when(number, char).otherwise(name)


def html_text(html: Column) -> Column:
    """Visible text: block tags become line breaks, other tags vanish, entities are decoded."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in DROPPED_ELEMENTS:
        out = F.regexp_replace(out, rf"(?is)<{name}\b.*?</{name}\s*>", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    out = F.regexp_replace(decode_entities(out), r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r" ?\n[ \n]*", "\n"))


def html_pages(documents: DataFrame, doc_id: str, html: str) -> DataFrame:
    """Web pages as a page table (doc_id, page_no, text): one page each, in the form the other extractors give.

    A null page has an empty text.
    """
    return documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.lit(0).cast("bigint").alias("page_no"),
                            F.coalesce(html_text(F.col(html)), F.lit("")).alias("text"))

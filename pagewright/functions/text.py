"""Text expressions: Column in, Column out, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

_BREAK = r"\r\n|[" + fv.LINE_BREAK + "]"
_PAGE_NUMBER = r"^\p{Nd}+$"
_LEADER = r"\.{4,}[" + fv.SPACE + r"]*\p{Nd}+$"
_REFERENCE = r"^\[\p{Nd}+\][" + fv.SPACE + "]"
_JUNK = f"{_PAGE_NUMBER}|{_LEADER}|{_REFERENCE}"
_SKIP = "(?iu)^(?:" + "|".join(fv.SKIP_HEADINGS) + ")[" + fv.SPACE + r"]*(?:[" + fv.LINE_BREAK + r"]|\z)"
_FIVE_WORDS = "^(?:[^{0}]+[{0}]+){{{1}}}[^{0}]".format(fv.SPACE, fv.SENTENCE_MIN_WORDS - 1)
# A blank run separates lines when it holds a line break, and sentences when it
# follows a stop.  Both start at a blank, so other characters are passed quickly.
_LINE_GAP = "[{0}]*[{1}][{0}]*".format(fv.SPACE, fv.LINE_BREAK)
_SENTENCE_GAP = "[{0}](?<=[{1}][{0}])[{0}]*|{2}".format(fv.SPACE, fv.SENTENCE_END, _LINE_GAP)
_EIGHT_CJK = "(?:[{0}][^[{0}]]*){{{1}}}".format(fv.CJK, fv.SENTENCE_MIN_CJK)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _trimmed_lines(text: Column) -> Column:
    """Stripped lines; runs of blank lines vanish."""
    return F.split(strip(text), _LINE_GAP)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fv.WHITESPACE))


def lines(text: Column) -> Column:
    return F.split(text, _BREAK)


def dense(text: Column) -> Column:
    """The text without any whitespace."""
    return F.regexp_replace(text, f"[{fv.SPACE}]+", "")


def dense_len(text: Column) -> Column:
    return F.length(dense(text))


def count_class(text: Column, char_class: str) -> Column:
    """How many characters of the class occur, without building an array of them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def cjk_ratio(text: Column) -> Column:
    return ratio(count_class(text, fv.CJK), dense_len(text))


def script_from_counts(dense_chars: Column, han: Column, kana: Column, hangul: Column) -> Column:
    """Script language from character counts; the order of the tests matters."""
    return (
        F.when(dense_chars <= 0, F.lit(None).cast("string"))
        .when(kana / dense_chars >= fv.KANA_SHARE, "ja")
        .when((hangul > han) & (hangul / dense_chars >= fv.HANGUL_SHARE), "ko")
        .when(han / dense_chars >= fv.HAN_SHARE, "zh")
    )


def script_counts(text: Column) -> Column:
    """Character counts that decide the script; they add up over the parts of a text."""
    return F.struct(
        dense_len(text).alias("dense"), count_class(text, fv.HAN).alias("han"),
        count_class(text, fv.KANA).alias("kana"), count_class(text, fv.HANGUL).alias("hangul"),
    )


def script_language(text: Column) -> Column:
    return bind(script_counts(text),
                lambda c: script_from_counts(c["dense"], c["han"], c["kana"], c["hangul"]))


def is_sentence_like(line: Column) -> Column:
    """``line`` must be stripped already."""
    return line.rlike(_FIVE_WORDS) | line.rlike(_EIGHT_CJK)


def is_junk(line: Column) -> Column:
    """Page numbers, dotted leaders, reference entries, single characters."""
    return (F.length(line) < 2) | line.rlike(_JUNK)


def content_lines(text: Column) -> Column:
    return F.filter(_trimmed_lines(text), lambda s: ~is_junk(s))


def prose_lines(text: Column) -> Column:
    return F.filter(content_lines(text), is_sentence_like)


def has_skip_heading(stripped: Column) -> Column:
    return stripped.rlike(_SKIP)


def clean_page(text: Column) -> Column:
    kept = F.when(cjk_ratio(text) >= fv.CJK_PAGE_RATIO, content_lines(text)).otherwise(prose_lines(text))
    return F.array_join(kept, "\n")


def sentences(text: Column) -> Column:
    """Sentences of every non-blank line, in order."""
    return F.filter(F.split(strip(text), _SENTENCE_GAP), lambda s: s != "")


def raw_words(text: Column) -> Column:
    """ASCII words as written, stop words included, in order of occurrence."""
    return F.regexp_extract_all(text, F.lit(fv.WORD), F.lit(0))


def is_stop_word(word: Column) -> Column:
    return word.isin(fv.STOP_WORDS)


def words(text: Column) -> Column:
    """Lower-cased ASCII words without the stop words."""
    return F.filter(F.transform(raw_words(text), F.lower), lambda w: ~is_stop_word(w))


def grams(text: Column, size: int) -> Column:
    """All runs of ``size`` consecutive characters, overlapping."""
    # The first look-ahead keeps matches from starting inside a surrogate pair.
    run = rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{size}}}))"
    return F.regexp_extract_all(text, F.lit(run), F.lit(1))


def han_bigrams(text: Column) -> Column:
    """Neighbouring pairs of Han characters; runs are cut at anything else."""
    runs = F.regexp_extract_all(text, F.lit(f"[{fv.HAN}]{{2,}}"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: grams(r, 2)))


def preview(text: Column, limit: int = fv.SCRIPT_PREVIEW_CHARS) -> Column:
    return F.concat(F.replace(F.left(text, F.lit(limit)), F.lit("\n"), F.lit(" ")), F.lit("…"))

"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a Column expression, so scan, measures and verdict are one
stage in the JVM without a shuffle, and any number of documents or partitions
is handled alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import let
from . import words as w

WINDOW = 8

# Frequent function words of the languages the table of rules is meant for.
STOP_WORDS = (
    "a", "al", "als", "an", "and", "are", "as", "at", "au", "auf", "aux", "avec", "be", "by", "con", "dans", "das", "de",
    "del", "dem", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "es", "est", "et", "for", "from", "für", "he",
    "im", "in", "is", "ist", "it", "la", "las", "le", "les", "lo", "los", "mit", "nicht", "no", "of", "on", "ou", "par",
    "para", "pas", "por", "pour", "que", "qui", "se", "sich", "su", "sur", "that", "the", "this", "to", "un", "una", "und",
    "une", "von", "was", "with", "y", "zu",
)


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [low, high]; a bound that is None does not count."""

    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.col(self.measure)
        bounds = [value >= self.low] if self.low is not None else []
        bounds += [value <= self.high] if self.high is not None else []
        return reduce(lambda a, b: a & b, bounds, F.lit(True))


# Fixed values of the method: length, symbols, stop words, lines.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_share", 0.04, None),
    Rule("dup_line_share", None, 0.5),
)


def _window_hashes(words: Column) -> Column:
    """A hash per window of eight words: of words, of pairs, of fours, of eights."""

    def joined(hashes: Column, step: int) -> Column:
        return w.bind(hashes, lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)))

    out = joined(joined(joined(F.transform(words, lambda x: F.xxhash64(x)), 1), 2), 4)
    return F.slice(out, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _pairs(values: Column, use) -> Column:
    """``use`` of each value and its successor; null after the last."""
    return F.zip_with(values, F.slice(values, 2, F.size(values)), use)


def _words_in_repeats(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes.

    Sorting brings equal windows together; the positions of all that have an
    equal neighbour are sorted again, and each covers the words up to the next,
    eight at most.
    """

    def positions(ordered: Column) -> Column:
        equal = _pairs(ordered, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = w.bind(ordered, positions)
    covered = w.bind(starts, lambda p: _pairs(p, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))))
    return F.aggregate(covered, F.lit(0), lambda total, x: total + x)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def measures(held: DataFrame) -> DataFrame:
    """Add to ``held`` (recorded columns, _text) n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words.

    Lines are cut at newlines and count if they hold a word.  A repeated word is
    one within an eight-word window found twice or more in its text, the first
    time included.  Null and empty texts measure 0 throughout.
    """
    stops = sorted({*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)})
    cut = let(held, _words=w.space_words(F.col("_text")),
              _lines=F.filter(F.split(F.coalesce("_text", F.lit("")), "\n", -1), lambda x: x.rlike(w.NOT_SPACE)))
    cut = let(cut, _joined=F.array_join("_words", ""), _hashes=_window_hashes(F.col("_words")))
    repeats = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    return cut.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length("_joined").cast("long"),
        "n_symbols": (F.length("_joined") - F.length(F.regexp_replace("_joined", "[#*$%&|<>]", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda x: x.isin(stops))).cast("long"),
        "n_repeat_words": F.when(repeats, _words_in_repeats(F.col("_hashes"))).otherwise(0).cast("long"),
    }).drop("_words", "_lines", "_joined", "_hashes")


def ratios() -> dict[str, Column]:
    """The measures that rules speak of, by name; null where the divisor is 0."""

    def share(a: str, b: str) -> Column:
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))

    return {
        "mean_word_chars": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
        "stop_word_share": share("n_stop_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
    }


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every document.

    ``base_failed``: fewer than 20 words, or more than 30 % of them repeated.
    ``kept``: not so, and every rule of the table holds.  A text without words
    fails.  Repeated rows get equal verdicts, further columns are carried along,
    and columns named like a measure are replaced.
    """
    found = let(measures(w.record(docs, _text=F.col(text))), _m=F.struct(*[c.alias(n) for n, c in ratios().items()]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    named = let(found.select(*w.recorded(found), *MEASURES, "_m.*"), base_failed=failed)
    kept = reduce(lambda a, b: a & b, [F.coalesce(r.holds(), F.lit(False)) for r in rules], ~F.col("base_failed"))
    return w.unrecord(named.withColumn("kept", kept), docs.columns, *MEASURES, *ratios(), "base_failed", "kept")

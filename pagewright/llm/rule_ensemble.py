"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled documents; every path from a root becomes a
rule, a conjunction of bounds on statistics.  A logistic regression with a lasso
penalty over the rules keeps a few of them, and these are compiled into one
Column expression, so scoring is a projection in the JVM.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import let
from ..session import stage
from . import quality_rules
from . import words as w

MAX_LABELLED = 20_000
TREES, DEPTH = 24, 3
LASSO = 0.002
LASSO_STEPS = 3000
STATISTICS = ("n_words", "mean_word_chars", "symbols_per_word", "stop_word_share", "dup_line_share", "repeat_share", "distinct_share",
              "again_share", "upper_share", "marks_per_word", "mean_line_words")


def statistics(held: DataFrame) -> DataFrame:
    """Add to ``held`` (recorded columns, _text) the STATISTICS of each whole text, all numbers; 0 where a divisor is 0.

    Shares are per word: in stop words, in repeated eight-word windows, distinct,
    equal to the word before, in capitals; marks are ! and ?.
    """
    base = let(quality_rules.measures(held), _words=w.space_words(F.col("_text")))
    n = F.col("n_words").cast("double")
    again = F.zip_with("_words", F.slice("_words", 2, F.size("_words")), lambda a, b: F.when(a == b, 1))

    def share(a: Column, b: Column = n) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    out = {name: F.coalesce(c, F.lit(0.0)) for name, c in quality_rules.ratios().items()}
    letters = F.length(F.regexp_replace(F.coalesce("_text", F.lit("")), r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(F.coalesce("_text", F.lit("")), r"[^\p{Lu}]+", ""))
    out |= {
        "repeat_share": share(F.col("n_repeat_words")), "distinct_share": share(F.size(F.array_distinct("_words"))),
        "again_share": share(F.size(F.array_compact(again))), "upper_share": share(capitals, letters.cast("double")),
        "marks_per_word": share(F.length(F.regexp_replace(F.coalesce("_text", F.lit("")), "[^!?]+", ""))),
        "mean_line_words": share(F.col("n_words"), F.col("n_lines").cast("double")),
    }
    found = let(base, _s=F.struct(n.alias("n_words"), *[c.alias(name) for name, c in out.items()]))
    return found.select(*w.recorded(found), "_s.*")


@dataclass(frozen=True)
class Bound:
    statistic: str
    above: bool  # else at most
    value: float

    def holds(self) -> Column:
        return F.col(self.statistic) > self.value if self.above else F.col(self.statistic) <= self.value


Rule = tuple[Bound, ...]


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights; the score is the logistic function of their sum."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule), F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [x.holds() for x in rule])


def tree_paths(description: str, names: tuple[str, ...] = STATISTICS) -> set[Rule]:
    """All paths from the root to inner and outer nodes of a tree, from its printed form.

    Of several bounds of one kind on a statistic the tightest is kept.
    """
    found, path = set(), {}
    for line in description.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = {d: b for d, b in path.items() if d < depth} | {depth: Bound(names[int(m[3])], m[4] == ">", float(m[5]))}
        tight: dict[tuple[str, bool], float] = {}
        for b in path.values():
            key = (b.statistic, b.above)
            tight[key] = b.value if key not in tight else (max if b.above else min)(tight[key], b.value)
        found.add(tuple(Bound(s, above, v) for (s, above), v in sorted(tight.items())))
    return found


def fit(labelled: DataFrame, seed: int = 5) -> RuleModel:
    """Grow trees, fit the lasso over their paths; ``labelled``: STATISTICS, label 0 or 1.

    Without labels every score is one half, with labels of one kind only the
    smoothed share of that kind.
    """
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return RuleModel((), math.log(share / (1 - share)))
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", subsamplingRate=0.7, seed=seed).fit(rows)
    rules = sorted(set().union(*(tree_paths(t.toDebugString) for t in forest.trees)), key=repr)
    # Rows that the same rules hold for differ in nothing else: Spark counts them, and
    # the lasso sees at most one row per pattern of the bounded sample.
    pattern = F.concat(*[_holds(rule).cast("int").cast("string") for rule in rules])
    counted = labelled.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("pattern").collect()
    x = np.array([[float(c) for c in r.pattern] for r in counted])
    weights, intercept = lasso(x, np.array([r.n for r in counted], float), np.array([r.ones for r in counted], float))
    return RuleModel(tuple((r, float(c)) for r, c in zip(rules, weights) if c != 0), float(intercept))


def lasso(x: np.ndarray, n: np.ndarray, ones: np.ndarray, penalty: float = LASSO, steps: int = LASSO_STEPS) -> tuple[np.ndarray, float]:
    """Logistic weights with an absolute penalty, and the intercept, by accelerated proximal gradients.

    Row i of ``x`` stands for ``n[i]`` observations, ``ones[i]`` of them positive.
    The step is the inverse of a bound on the curvature, so the loss falls to its
    one minimum.
    """
    share, total = n / n.sum(), ones / n.sum()
    rows = np.hstack([x, np.ones((len(x), 1))])
    step = 4 / np.linalg.eigvalsh((rows * share[:, None]).T @ rows)[-1]
    now = ahead = np.zeros(rows.shape[1])
    pace = 1.0
    for _ in range(steps):
        gradient = rows.T @ (share / (1 + np.exp(-(rows @ ahead))) - total)
        new = ahead - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        now, ahead, pace = new, new + (pace - 1) / faster * (new - now), faster
    return now[:-1], now[-1]


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, seed: int = 5) -> RuleModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, quality).

    Held-out rows, null ids and null labels are not learned from.  Of more than
    ``most`` labelled rows a share is drawn by a hash of doc_id that leaves
    about that many; this bounds the sample and its broadcast.  A doc_id labelled
    twice counts twice, and so does one with two texts.
    """
    usable = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    n = usable.count()
    chance = min(1.0, most / max(n, 1))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(chance * 1_000_000))
    drawn = drawn.select("doc_id", F.col("quality").cast("double").alias("label"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    held = w.record(chosen.select("doc_id", "label", "text"), _text=F.col("text")).drop("_r2")
    sample = w.unrecord(statistics(held), ["doc_id", "label"], *STATISTICS)
    # One layout of the sample for any layout of the input, so a rerun draws the same trees.
    ordered = stage(sample.repartition(4, "doc_id").sortWithinPartitions("doc_id", *STATISTICS, "label"), "labelled")
    return fit(ordered.drop("doc_id"), seed)


def score_documents(docs: DataFrame, model: RuleModel, least: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if score >= least, else 0) to every row.

    Null and empty texts have statistics 0 and are scored like any other; equal
    rows score equally; columns called like the results are replaced.
    """
    return w.unrecord(_scored(docs, model, least), docs.columns, "score", "predicted")


def _scored(docs: DataFrame, model: RuleModel, least: float) -> DataFrame:
    found = let(statistics(w.record(docs, _text=F.col("text"))), score=model.score())
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))


def accepted(docs: DataFrame, model: RuleModel, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns as they were."""
    return w.unrecord(_scored(docs, model, least).filter("predicted = 1"), docs.columns)

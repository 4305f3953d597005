"""Quality rules, rule ensemble, licenses, lines: edges and brute force."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.llm import line_dedup, patience, quality_rules, rule_ensemble
from pagewright.llm import queries

SF_DIR = "/root/testdata/sf0.001"


# --- quality rules ---------------------------------------------------------------------

def repeated_words(words, window=8):
    seen, covered = {}, set()
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(window)}
    return len(covered)


def test_rules_on_edges(docs):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for i in (2, 3, 4):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_lines, got[i].n_repeat_words) == (0, 0, 0, 0, 0)
        assert got[i].base_failed and not got[i].kept
    assert got[10].n_repeat_words == 400 and got[10].base_failed
    assert got[1].kept and got[5].base_failed


def test_rules_count_repeats_like_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["a b c d e f g h " * 3, "a " * 9, "a " * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.apply_rules(df).collect():
        assert r.n_repeat_words == repeated_words(r.text.split()), r.text


def test_rules_with_clashing_columns_and_no_rows(clashing, none):
    got = quality_rules.apply_rules(clashing)
    assert "_rec" in got.columns and "odd.name" in got.columns and got.columns.count("n_words") == 1
    assert got.filter("doc_id = 5").select("n_words").first()[0] == 1
    assert quality_rules.apply_rules(none).count() == 0


# --- rule ensemble ---------------------------------------------------------------------

def test_tree_paths_keep_the_tightest_bounds():
    text = ("  If (feature 0 <= 5.0)\n   If (feature 0 <= 2.5)\n    Predict: 0.0\n   Else (feature 0 > 2.5)\n    Predict: 1.0\n"
            "  Else (feature 0 > 5.0)\n   Predict: 1.0\n")
    bound = rule_ensemble.Bound
    assert rule_ensemble.tree_paths(text, ("n",)) == {
        (bound("n", False, 5.0),), (bound("n", False, 2.5),), (bound("n", False, 5.0), bound("n", True, 2.5)), (bound("n", True, 5.0),)}


def test_held_out_follows_the_checksum(spark):
    for r in spark.range(50).select("id", rule_ensemble.held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op1_rule_ensemble(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.95
    assert scored["score"].between(0, 1).all()


def test_scores_do_not_depend_on_the_input_layout(spark, small):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert rule_ensemble.train(small, labels) == rule_ensemble.train(small.repartition(7), labels.repartition(3))


def test_models_without_labels_and_with_one_kind(spark, docs, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    model = rule_ensemble.train(docs, no_labels)
    assert {r.score for r in rule_ensemble.score_documents(docs, model).collect()} == {0.5}
    ids = [i for i in range(1, 11) if zlib.crc32(str(i).encode()) % 4 != 2]
    good = spark.createDataFrame([(i, 1) for i in ids] + [(None, 0), (3, None)], "doc_id long, quality int")
    model = rule_ensemble.train(docs, good)
    assert all(r.score > 0.5 for r in rule_ensemble.score_documents(docs, model).collect())
    assert rule_ensemble.score_documents(none, model).count() == 0


def test_scoring_leaves_columns_alone(clashing, spark):
    model = rule_ensemble.RuleModel((((rule_ensemble.Bound("n_words", True, 5.0),), 4.0),), -2.0)
    got = rule_ensemble.score_documents(clashing, model)
    assert {r.doc_id: r.predicted for r in got.collect()}[9] == 0 and {r.doc_id: r.predicted for r in got.collect()}[7] == 1
    kept = rule_ensemble.accepted(clashing, model)
    assert kept.columns == clashing.columns and {r.score for r in kept.collect()} == {77.0}


# --- licenses --------------------------------------------------------------------------

def test_rising_is_longest():
    def brute(xs):
        best = [1] * len(xs)
        for i in range(len(xs)):
            best[i] = 1 + max([best[j] for j in range(i) if xs[j] < xs[i]], default=0)
        return max(best, default=0)

    rng = random.Random(5)
    for _ in range(200):
        xs = rng.sample(range(40), rng.randint(0, 12))
        got = [xs[i] for i in patience.rising(xs)]
        assert got == sorted(got) and len(got) == brute(xs)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_is_common_and_rising():
    rng = random.Random(6)
    for _ in range(300):
        template = [f"w{rng.randint(0, 30)}".encode() for _ in range(rng.randint(1, 15))]
        text = [x for x in template if rng.random() > 0.2]
        for _ in range(rng.randint(0, 4)):
            text.insert(rng.randint(0, len(text)), b"w%d" % rng.randint(0, 40))
        pairs = patience.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(text, template)
        if len(set(template)) == len(template) and len(set(text)) == len(text):
            assert len(pairs) == lcs(text, template)


def test_licenses_in_texts(spark, docs, none):
    gpl = patience.TEMPLATES["GPL-3.0"]
    noise = "This is the work of a general version of the public and is 3 "
    rows = [(1, noise * 30 + gpl + noise * 30), (2, gpl + "\n" + gpl), (3, gpl.replace("General ", "").upper()), (4, noise * 50),
            (5, patience.TEMPLATES["MIT"] + " Then " + gpl), (6, None), (7, "")]
    got = {r.doc_id: [x.license for x in r.licenses] for r in patience.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[3] == ["GPL-3.0"] and sorted(got[5]) == ["GPL-3.0", "MIT"]
    assert got[4] == got[6] == got[7] == []
    spans = patience.scan_licenses(spark.createDataFrame(rows[:1], "doc_id long, text string")).first().licenses[0]
    assert (spans.coverage, spans.last_word - spans.first_word) == (1.0, len(patience.scan_words(gpl)) - 1)
    assert patience.scan_licenses(docs).count() == docs.count() and patience.scan_licenses(none).count() == 0


def _found(words, name):
    template = patience.scan_words(patience.TEMPLATES[name])
    places = {}
    for at, x in enumerate(words):
        places.setdefault(x, []).append(at)
    return patience.stretches(words, places, template, 0.8)


def test_repeated_notices_are_all_found_in_linear_time():
    mit = patience.scan_words(patience.TEMPLATES["MIT"])
    started = time.process_time()
    assert [h[1:] for h in _found(mit * 40_000, "MIT")] == [(at, at + len(mit) - 1) for at in range(0, 40_000 * len(mit), len(mit))]
    edited = patience.scan_words(patience.TEMPLATES["MIT-text"])
    edited[40] = b"other"
    hits = _found(edited * 300, "MIT-text")
    assert len(hits) == 300 and all(h[0] == (len(edited) - 1) / len(edited) and h[2] - h[1] == len(edited) - 1 for h in hits)
    assert time.process_time() - started < 60


def test_taken_stretches_meet_no_other():
    rng = random.Random(5)
    taken, plain = patience._Taken(), []
    for _ in range(2000):
        low = rng.randrange(3000)
        high = low + rng.randrange(40)
        free = all(high < a or low > b for a, b in plain)
        assert taken.free(low, high) == free
        if free:
            taken.add(low, high)
            plain.append((low, high))
        elif rng.random() < 0.3:
            taken.give_back(*plain.pop(rng.randrange(len(plain))))


def test_licenses_with_clashing_columns(clashing):
    got = patience.scan_licenses(clashing)
    assert got.columns == ["doc_id", "licenses"] and got.count() == clashing.count()
    twice = patience.scan_licenses(clashing.withColumn("licenses", clashing["doc_id"]).withColumn("coverage", clashing["doc_id"]))
    assert twice.columns == ["doc_id", "licenses"] and twice.count() == clashing.count()


@pytest.mark.parametrize("name", patience.TEMPLATES)
def test_each_template_is_found_among_other_words(spark, name):
    text = f"words before {patience.TEMPLATES[name].upper()} and words after"
    row = patience.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    best = {x.license: x.coverage for x in row.licenses}
    assert best[name] == 1.0 and row.licenses[0].coverage == 1.0


def test_all_planted_notices_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op4_license_patience(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    notice = F.col("text").contains("censed under ") | F.col("text").contains("Released under the MIT License.")
    assert found.filter(notice != F.col("license").isNotNull()).count() == 0


def notices(rng, names, drop=0):
    """Words of a text with these notices among noise, less ``drop`` words of each, and where each lies."""
    words, at = [], []
    for name in names:
        words += [f"noise{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))]
        held = [x.decode() for x in patience.scan_words(patience.TEMPLATES[name])]
        n = len(held)
        for k in sorted(rng.sample(range(1, n - 1), drop), reverse=True):
            del held[k]
        at.append((name, len(held) / n, len(words), len(words) + len(held) - 1))
        words += held
    return " ".join(words), at


def test_all_notices_and_their_repeats_are_reported(spark, tmp_path):
    rng = random.Random(12)
    long_names = ["MIT-text", "Apache-2.0-header"]
    rows, want = [], {}
    for d in range(60):
        text, at = notices(rng, [rng.choice(["MIT", *long_names]) for _ in range(rng.randint(0, 6))], 0)
        rows.append((d, text))
        want[d] = sorted(at)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op4_license_patience(spark, str(tmp_path)).collect():
        got = sorted((x.license, s.coverage, s.first_word, s.last_word) for x in r.licenses for s in x.stretches)
        assert [x for x in got if x[0] != "Apache-2.0"] == want[r.doc_id], r.doc_id
        assert r.n_licenses == len(r.licenses) == len({x.license for x in r.licenses})
        assert all((x.coverage, x.first_word, x.last_word) == tuple(x.stretches[0]) for x in r.licenses)


def test_notices_without_their_rarest_words_are_found():
    """A notice that lacks as many words as it may, the rarest of the text among them, which stand elsewhere."""
    rng = random.Random(13)
    for name in ("MIT-text", "Apache-2.0-header", "GPL-3.0"):
        template = patience.scan_words(patience.TEMPLATES[name])
        single = [x for x in template if template.count(x) == 1]
        lacking = int(0.2 * len(template) + 1e-9)
        for _ in range(10):
            gone = set(rng.sample(single, lacking))
            held = [x for x in template if x not in gone]
            noise = [b"noise%d" % k for k in range(150)]
            often = [x for x in set(held) for _ in range(4)]
            rng.shuffle(often)
            spaced = [x for w in often for x in (w, *noise[:7])]
            text = [*sorted(gone), *noise, *spaced, *noise, *held, *noise]
            places = {}
            for i, x in enumerate(text):
                places.setdefault(x, []).append(i)
            found = patience.stretches(text, places, template, 0.8)
            assert len(found) == 1 and found[0][0] >= len(held) / len(template), name
            every = [patience.around(text, template, p, j) for p, x in enumerate(text) for j, y in enumerate(template) if x == y]
            assert found[0] == min((h for h in every if h[0] >= 0.8), key=lambda h: (-h[0], h[2] - h[1], h[1]))


# --- lines -----------------------------------------------------------------------------

def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_report(rows):
    first, out = {}, {}
    for doc, text in sorted(rows):
        for i, line in enumerate(text.split("\n")):
            words = tuple(line.lower().split())
            if words:
                first.setdefault(words, (doc, i))
                out.setdefault(doc, [0, 0, 0])[0] += 1
    for words, place in first.items():
        near = len(words) >= 5 and any(p < place and len(o) >= 5 and within_one(words, o) for o, p in first.items())
        out[place[0]][2 if near else 1] += 1
    return {d: (n, n - f - x, x, f) for d, (n, f, x) in out.items()}


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(d, "\n".join(" ".join(rng.choice("abcD") for _ in range(rng.choice((0, 3, 5, 6, 7)))) for _ in range(12))) for d in range(30)]
    rows += [(100, "one two three four five six"), (101, "One two three four five"), (102, "one two three four five six seven\nz one two three four five")]
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_report(rows)
    for r in got:
        assert (r.n_lines, r.n_exact, r.n_near, r.n_kept) == want.get(r.doc_id, (0, 0, 0, 0)), r


def brute_kept(rows, least):
    """The texts without lines that equal an earlier one or, from ``least`` words on, are within one edit of one."""
    seen, out = [], {}
    for d, text in rows:
        kept = []
        for line in text.split("\n"):
            words = line.lower().split()
            if not words or not any(words == x or min(len(words), len(x)) >= least and one_edit(words, x) for x in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[d] = "\n".join(kept)
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_texts_without_the_lines_that_go(spark, tmp_path):
    rng = random.Random(14)
    rows = [(d, "\n".join(" ".join(rng.choice("abcD") for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 7)))) for _ in range(10))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_kept(rows, 5)
    got = queries.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_chars, r.text_sha256) for r in got} == {d: (len(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in want.items()}
    counts = brute_report(rows)
    assert {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.n_kept) for r in got} == {d: counts.get(d, (0, 0, 0, 0)) for d, _ in rows}
    for least in (2, 3):
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, least).collect()} == brute_kept(rows, least)


def test_lines_on_edges(docs, clashing, none):
    got = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert len(got) == 11 and got[2].n_lines == got[3].n_lines == got[4].n_lines == 0
    assert got[5].n_kept == 1 and got[6].n_exact == 1 and got[8].n_near == 1
    assert line_dedup.line_report(none).count() == 0
    kept = line_dedup.dedup_lines(clashing)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[6] == "" and texts[2] is None and texts[4] == " \t\n " and texts[8] == ""


def test_a_text_of_very_many_lines(spark):
    # Equal, near and blank lines among 60,000: the work follows the lines, not their square.
    lines = [f"line {i // 2} of one very long text {i}" if i % 3 else "" if i % 2 else "the same line over and over" for i in range(60_000)]
    row = line_dedup.line_report(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert row.text == brute_fast(lines)


def brute_fast(lines):
    """Texts of the lines above: equal ones go, and those that differ from an earlier one by a word."""
    seen, kept = set(), []
    for line in lines:
        words = line.split()
        marks = {(i, *words[:i], None, *words[i + 1 :]) for i in range(len(words))}
        if not words or not marks & seen:
            kept.append(line)
        seen |= marks
    return "\n".join(kept)


def test_hot_line_keys_do_not_pair_up(spark):
    # 3,000 lines that differ in one word: all but the first go.
    rows = [(i, f"this page was seen {i} times by all") for i in range(3000)]
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_near"), F.sum("n_kept")).first()
    assert tuple(got) == (2999, 1)

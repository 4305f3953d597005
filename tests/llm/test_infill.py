"""Fill in the middle against plain Python: counts, cuts, chunks, round trips, edges."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import infill as fim
from pagewright.llm import words as w

TOKEN = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
TINY = fim.Chunking(least=1, most=7, bits=2)


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return text, len(tokens), "plain", None, None
    low, high = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if h[3] % 100 < 80:
        return f"<S>{s}<P>{p}<M>{m}", len(tokens), "spm", len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", len(tokens), "psm", len(p), len(m)


def located(texts, chunking=TINY, cache=None):
    raw, offsets = w.text_bytes(pa.array(texts, pa.string()))
    return fim.Located(raw, offsets, chunking, cache or fim.Summaries())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n\t \x1c𝄞"), max_size=40), max_size=6))
def test_counts_and_cuts(texts):
    at = located(texts)
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        assert at.counts[i] == len(tokens)
        for k in range(len(tokens) + 1):
            head = "".join(tokens[:k])
            assert at.cut(i, k) == (at.offsets[i] + len(head.encode()), len(head))


def test_chunks_follow_the_content():
    """A passage keeps its chunks wherever it stands, so its summaries are found again."""
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    cache = fim.Summaries()
    located([passage], fim.Chunking(), cache)
    assert cache.hits == 0
    at = located(["other words " * 7 + passage + " and an end"], fim.Chunking(), cache)
    assert cache.hits > 0.9 * len(at.ends)
    assert max(np.diff(np.append(0, at.ends))) <= fim.Chunking().most
    assert at.counts[0] == 14 + 30_000 + 3


def test_cache_that_overflows_gives_the_same():
    texts = ["one two  three\n" * i for i in range(1, 40)]
    want = located(texts).counts.tolist()
    small = fim.Summaries(room=10)
    for _ in range(2):
        assert located(texts, TINY, small).counts.tolist() == want
        assert small.held <= max(10, sum(map(len, texts)))


def test_rolling_hash_covers_its_window():
    raw = np.random.default_rng(3).integers(0, 256, 200).astype(np.uint8)
    got = fim.rolling(raw)
    for i in (0, 1, 30, 31, 32, 150, 199):
        want = sum(int(fim.GEAR[raw[i - k]]) << k for k in range(min(32, i + 1))) % 2**32
        assert int(got[i]) == want
    assert len(fim.rolling(raw[:0])) == 0 and len(fim.rolling(raw[:1])) == 1


def test_documents_equal_brute_force(docs):
    marks = [(20 + i, t, None, None) for i, t in enumerate(("has <P> in it", "<S>", "a <M", "<<S>", "x" * 40_000, " " * 40_000, " lead and trail \n", "a\x1cb c"))]
    rows = docs.unionByName(docs.sparkSession.createDataFrame(marks * 3 + [(100 + i, f"w{i} and more words \n here <", "s", None) for i in range(200)], docs.schema))
    out = fim.infill(rows).withColumn("back", fim.restored(F.col("text"), F.col("form")))
    got = sorted(map(repr, ((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.back) for r in out.collect())))
    want = sorted(map(repr, ((r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in rows.collect())))
    assert got == want
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_all_documents_can_be_rearranged(docs):
    out = fim.infill(docs, percent=100, suffix_first=0)
    assert {r.form for r in out.filter("length(text) > 0").collect()} == {"psm"}
    assert {r.form for r in fim.infill(docs, percent=0).collect()} == {"plain"}


def test_columns_pass_and_clash(clashing, none):
    out = fim.infill(clashing.withColumns({"n": F.lit(1), "form": F.lit("x"), "middle_chars": F.lit(2)}))
    assert sorted(out.columns) == sorted([*clashing.columns, "n", "form", "prefix_chars", "middle_chars"])
    assert out.filter("n_words = 77 AND _key = 77 AND `odd.name` = 77 AND n = 22").count() == 2
    assert fim.infill(none).count() == 0


@pytest.mark.parametrize("layout", [1, 5])
def test_layouts_agree(small, layout):
    want = sorted(map(repr, fim.infill(small.select("doc_id", "text")).collect()))
    assert sorted(map(repr, fim.infill(small.select("doc_id", "text").repartition(layout)).collect())) == want

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import packing
from pagewright.operators.requests import translation_windows
from pagewright.operators.windows import windows


def groups(sizes, budget, gap):
    """Which items share a pack, by their positions."""
    out = []
    total = None
    for at, size in enumerate(sizes):
        if total is None or total + size > budget:
            out.append([at])
            total = size
        else:
            out[-1].append(at)
            total += gap + size
    return out


def packed(spark, docs, budget, page_bits=packing.PAGE_BITS):
    rows = [(d, n, t) for d, texts in docs.items() for n, t in enumerate(texts)]
    random.Random(7).shuffle(rows)
    pages = spark.createDataFrame(rows, "doc_id string, page_no long, text string")
    got = {}
    for r in packing.chunk_pages(pages, budget, page_bits).collect():
        got.setdefault(r.doc_id, {})[r["index"]] = r.original
    return {d: [c[i] for i in sorted(c)] for d, c in got.items()}, got


def texts_of(sizes):
    letters = itertools.cycle("abcdefghijklmnopqrstuvwxyz")
    return [next(letters) * z for z in sizes]


def test_small_cases(spark):
    docs = {"plain": texts_of([3, 2, 4, 1]), "big": texts_of([2, 20, 2]), "gaps": ["", "ab", "", "c", ""], "none": ["", ""]}
    got, _ = packed(spark, docs, 6)
    assert got["plain"] == ["aaa\n\nbb", "cccc\n\nd"]
    assert got["big"] == ["aa", "b" * 20, "cc"]
    assert got["gaps"] == ["ab\n\nc"]
    assert "none" not in got


@pytest.mark.parametrize("block_bits,fan_bits,page_bits,budget", [(1, 1, 3, 10), (1, 1, 5, 25), (2, 1, 5, 40), (6, 12, 42, 300)])
def test_blocks_do_not_show(spark, monkeypatch, block_bits, fan_bits, page_bits, budget):
    """Any cut into blocks gives what one walk over the pages gives."""
    monkeypatch.setattr(packing, "BLOCK_BITS", block_bits)
    monkeypatch.setattr(packing, "FAN_IN_BITS", fan_bits)
    rng = random.Random(budget)
    docs = {}
    for d in range(40):
        low, high = rng.choice([(1, 2), (1, 5), (0, 12), (1, budget + 4), (budget - 4, budget + 4)])
        docs[f"d{d}"] = texts_of([rng.randint(low, high) for _ in range(rng.choice([1, 2, 5, 17, 40]))])
    got, raw = packed(spark, docs, budget, page_bits)
    for d, texts in docs.items():
        texts = [t for t in texts if t]
        want = ["\n\n".join(texts[i] for i in g) for g in groups([len(t) for t in texts], budget, 2)]
        assert got.get(d, []) == want
        assert sorted(raw.get(d, {})) == list(range(len(want)))
        for chunk in want:
            assert chunk and (len(chunk) <= budget + 2 or chunk in texts)


def test_stored_sizes_give_the_same_chunks(spark):
    rows = [("d", n, t) for n, t in enumerate(texts_of([3, 0, 8, 2, 2, 9]))]
    pages = spark.createDataFrame(rows, "doc_id string, page_no long, text string")
    plain = packing.chunk_pages(pages, 10).collect()
    sized = packing.chunk_pages(pages.withColumn("size", F.length("text")), 10).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, sized)) and len(plain) == 4


def test_null_sizes_and_keys(spark):
    """A null size is measured; what belongs to no chunk is given out with its reason."""
    rows = [("d", n, t, None if n % 2 else len(t)) for n, t in enumerate(texts_of([3, 0, 8, 2, 2, 9]))]
    rows += [(None, 1, "lost", 4), ("d", None, "lost too", None), (None, None, None, None), ("e", 0, None, None)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no long, text string, size long")
    want = packing.chunk_pages(pages.drop("size"), 10).collect()
    assert sorted(map(tuple, packing.chunk_pages(pages, 10).collect())) == sorted(map(tuple, want)) and len(want) == 4
    got = packing.rejected_pages(pages)
    assert got.columns == [*pages.columns, "reason"]
    assert sorted((r.reason, r.text or "") for r in got.collect()) == [("no doc_id", ""), ("no doc_id", "lost"), ("no page_no", "lost too")]


def test_one_document_with_most_pages(spark):
    docs = {"hot": texts_of([5] * 700)}
    docs.update({f"d{i}": texts_of([4, 4]) for i in range(20)})
    got, _ = packed(spark, docs, 26)
    assert "".join(got["hot"]).replace("\n", "") == "".join(docs["hot"])
    assert {len(c) for c in got["hot"][:-1]} == {26}


def test_texts_are_shuffled_once(spark):
    pages = spark.range(500).select((F.col("id") % 3).cast("string").alias("doc_id"), F.col("id").alias("page_no"),
                                    F.repeat(F.lit("x"), 40).alias("text"))
    chunks = packing.chunk_pages(pages, 300)
    chunks.collect()
    final = chunks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Range (") == 1
    assert "CartesianProduct" not in final and "BroadcastNestedLoop" not in final


def test_tree_depth():
    assert [packing._levels(b) for b in (10, 18, 30, 31, 42, 43)] == [1, 1, 1, 2, 2, 3]


def test_windows(one):
    def parts(*sizes):
        return [chr(97 + i) * (z - 1) + "." for i, z in enumerate(sizes)]

    for sizes in [(699, 699), (699, 700), (700, 700), (1, 1398, 5), (1500, 10, 1400), (30,) * 120]:
        sents = parts(*[z % 1600 for z in sizes[:26]]) if len(sizes) < 27 else ["abcdefghijklmnopqrstuvwxyzabc."] * 120
        want = [" ".join(sents[i] for i in g) for g in groups_of_windows([len(s) for s in sents])]
        assert one(lambda t: windows(t), " ".join(sents)) == want
    assert one(windows, ["", " \n ", "no stop"]) == [[], [], ["no stop"]]


def groups_of_windows(sizes, limit=1400):
    out, used = [], 0
    for at, size in enumerate(sizes):
        if out and used + size + 1 <= limit:
            out[-1].append(at)
            used += size + 1
        else:
            out.append([at])
            used = size
    return out


def test_translation_windows_number_windows(spark):
    chunks = spark.createDataFrame([("d", 0, "One. Two. Three.")], "doc_id string, index int, original string")
    rows = translation_windows(chunks, 9).orderBy("win_idx").collect()
    assert [(r.win_idx, r.window) for r in rows] == [(0, "One. Two."), (1, "Three.")]

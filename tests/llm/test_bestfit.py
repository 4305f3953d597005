"""Packing against plain Python: ids, pieces, the plan, places, sequences."""

import random
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import bestfit, queries

ENCODER = bestfit.Encoder(bestfit.VOCABULARY)
PLAIN = Tokenizer.from_file(public_tokenizers.path(bestfit.VOCABULARY))


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def brute_pieces(rows, most=bestfit.SEQUENCE):
    out = []
    for doc, text in rows:
        ids, at, piece = [*plain_ids(text), 0], 0, 0
        while at < len(ids):
            end = at + (len(ids) - at - 1) % most + 1
            raw = struct.pack(f"<{end - at}I", *ids[at:end])
            out.append((doc, piece, at, end - at, zlib.crc32(raw), raw))
            at, piece = end, piece + 1
    return out


def brute_bins(lengths, most):
    """How many sequences best fit by decreasing length opens, piece by piece."""
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(rooms, length)
        n += at == len(rooms)
        room = rooms.pop(at) if at < len(rooms) else most
        insort(rooms, room - length)
    return n


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t.,'s1ab_<|>"), st.characters(codec="utf-8")), max_size=60))
def test_units_give_the_same_ids(text):
    assert ENCODER.encode([text, f"x {text} y"]) == [np.array(plain_ids(t), "<u4").tobytes() for t in (text, f"x {text} y")]


def test_special_strings_and_full_caches(monkeypatch):
    texts = ["a <|endoftext|> b<|endoftext|>", "", " ", "w" * 5000, "漢字 " * 300, "it's they'll, 'tis  so"]
    want = [np.array(plain_ids(t), "<u4").tobytes() for t in texts]
    monkeypatch.setattr(bestfit, "CACHED_UNITS", 2)
    encoder = bestfit.Encoder(public_tokenizers.path(bestfit.VOCABULARY))
    for _ in range(3):
        assert encoder.encode(texts) == want
    assert encoder.older and all(len(u) <= bestfit.CACHED_CHARS for u in encoder.known | encoder.older)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda most: st.tuples(st.just(most), st.lists(st.tuples(st.integers(1, most), st.integers(1, 30)), max_size=15))))
def test_plan_is_best_fit(case):
    most, counted = case
    histogram = Counter()
    for length, n in counted:
        histogram[length] += n
    planned = bestfit.plan(histogram, most)
    lengths = np.repeat(np.array(list(histogram), np.int64), list(histogram.values()))
    ranks = np.concatenate([np.arange(n) for n in histogram.values()] or [np.zeros(0)]).astype(np.int64)
    if not len(lengths):
        assert not len(planned)
        return
    sequence, offset = bestfit.place(planned, lengths, ranks)
    held = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist()):
        held[s].append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= most
    assert len(held) == brute_bins(lengths.tolist(), most) == max(held) + 1


def test_plan_stays_small():
    rng = random.Random(6)
    histogram = {n: rng.randrange(1, 10**9) for n in range(1, 2049)}
    planned = bestfit.plan(histogram)
    assert len(planned) < 20_000
    assert planned["n"].sum() == sum(histogram.values())
    # No packing needs fewer sequences than the tokens fill, or than there are pieces of over half a sequence.
    least = max(sum(n * c for n, c in histogram.items()) / 2048, sum(c for n, c in histogram.items() if n > 1024))
    assert (planned["sequence"] + -(-planned["n"] // planned["each"])).max() < 1.005 * least


def checked(rows, places, pieces, most):
    want = sorted(map(repr, ((r[0], *r[1:5]) for r in brute_pieces(rows, most))))
    got = places.collect()
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= most
    assert len(held) == brute_bins([r.length for r in got], most)
    ids = {r.sequence_id: r for r in bestfit.sequences(pieces, places).collect()}
    assert set(ids) == set(held)
    text = defaultdict(dict)
    for r in got:
        text[(r.doc_id, r.ids_crc32)][r.start] = ids[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]
    raw = {(r[0], r[4]): r[5] for r in brute_pieces(rows, most)}
    assert all(part == raw[key] for key, parts in text.items() for part in parts.values())
    assert all(len(r.ids) == 4 * r.n_tokens for r in ids.values())
    return len(held)


def test_documents_equal_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for most in (2048, 100):
        pieces = bestfit.stored(docs, most=most)
        checked(rows, bestfit.packed(pieces, most), pieces, most)


def test_hot_lengths_copies_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(bestfit, "COPIES", 7)
    rng = random.Random(2)
    rows = [(i, "equal text of some words") for i in range(300)] + [(5, "the same row")] * 100 + [(None, None)] * 30
    rows += [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 60)))) for i in range(1000, 1200)]
    pieces = bestfit.stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), most=64)
    n = checked(rows, bestfit.packed(pieces, 64), pieces, 64)
    assert n <= 1.02 * sum(len(plain_ids(t)) + 1 for _, t in rows) / 64 + 1


def test_layouts_agree(small):
    slim = small.select("doc_id", "text")
    one, two = (sorted(map(repr, bestfit.packed(bestfit.stored(slim.repartition(n))).collect())) for n in (1, 6))
    assert one == two


def test_no_documents_and_other_columns(clashing, none):
    assert bestfit.packed(bestfit.stored(none)).count() == 0
    clash = clashing.withColumns({c: F.lit("x") for c in ("piece", "start", "length", "ids", "rank", "offset")})
    assert bestfit.packed(bestfit.stored(clash)).count() == bestfit.packed(bestfit.stored(clashing)).count()


def test_query_packs_every_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op13_bestfit_packing"](spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == sorted(r[:5] for r in brute_pieces(rows))
    assert got.select("sequence_id").distinct().count() == brute_bins([r[3] for r in brute_pieces(rows)], 2048)

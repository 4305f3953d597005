"""Phrase index, near duplicates, mixing, chat, shards, archives: edges, brute force, round trips."""

import gzip
import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import bbit_minhash, chat, mixing, phrase_index, shards, warc
from pagewright.llm.components import components
from pagewright.session import scratch_dir, stage


# --- phrase index ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([
        (1, "sat on the mat and the dog lay by the door"), (2, "ONE"), (3, None), (4, "..."), (None, "one"), (5, "no such words anywhere here"),
        (6, "the the the"), (1, "word3 and the")], "item_id long, text string")


def test_contamination_on_edges(docs, items, none):
    got = {r.doc.doc_id: r for r in phrase_index.contamination(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (11, 1, True)
    assert got[1].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert (got[5].n_words, got[5].n_hit, got[5].items_sha256) == (1, 1, hashlib.sha256(b"2").hexdigest())
    assert got[7].n_hit == 3 * len([i for i in range(9000) if i % 977 == 3])
    for i in (2, 3, 4, 9, 10):
        assert (got[i].n_hit, got[i].contaminated, got[i].items_sha256) == (0, False, hashlib.sha256(b"").hexdigest())
    assert phrase_index.contamination(none, items).count() == 0
    assert phrase_index.contamination(docs, items.limit(0)).filter("contaminated").count() == 0


def test_decontaminated_keeps_columns(clashing, items):
    kept = phrase_index.decontaminated(clashing, items)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 9, 10]


def test_blocks_of_terms_give_the_same(docs, items, monkeypatch):
    want = sorted(map(repr, phrase_index.contamination(docs, items).collect()))
    monkeypatch.setattr(phrase_index, "TERMS_PER_PASS", 4)
    monkeypatch.setattr(phrase_index, "BROADCAST_WINDOWS", 0)
    assert sorted(map(repr, phrase_index.contamination(docs, items).collect())) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x x beta"), (2, "alpha " + "x " * 50 + "beta"), (3, "alpha alpha")], "doc long, text string")
    items = spark.createDataFrame([(9, "beta alpha")], "item_id long, text string")
    windows = stage(phrase_index.test_windows(items), "w")
    counts = phrase_index.term_counts(docs, windows.select(F.explode("words").alias("term")))
    anchors = stage(phrase_index.rarest_terms(windows, counts), "a")
    index = phrase_index.build_index(docs, None)
    near = phrase_index.proximity_matches(index, windows, anchors, slop=10).collect()
    assert [(r.doc, r.item_id) for r in near] == [(1, 9)]
    assert phrase_index.phrase_matches(index, windows, anchors).count() == 0


# --- near duplicates -------------------------------------------------------------------

def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, similar=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i, _ in rows}, {i: len(s) for i, s in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice((40, 120, 200)))]
        rows += [edited(rng, base, rng.choice((0, 1, 1, 2, 3))) for _ in range(25)]
    rows += ["", None, "a b", "A  b", "a b c d e", "a b c d", " "] + ["same text of a few words only"] * 5
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want, sizes = brute_components(rows)
    got = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_large_groups_of_near_copies_are_one(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, 1)) for i in range(400)] + [(400 + i, " ".join(base)) for i in range(300)]
    got = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("component_id <> 0").count() == 0


def test_bound_is_an_argument(spark):
    """Pairs of similarity 0.80 to 0.85 are near duplicates at 80 per cent and not at 85."""
    assert bbit_minhash.least_estimate(85) == 0.68 and 0.6 < bbit_minhash.least_estimate(80) <= 0.62
    rng = random.Random(9)
    rows = []
    while len(rows) < 80:
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = edited(rng, base, rng.choice((5, 6)))
        a, b = shingle_set(" ".join(base)), shingle_set(other)
        if 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b):
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bbit_minhash.deduplicated(docs, 85).count() == 80
    assert sorted(r.doc_id for r in bbit_minhash.deduplicated(docs, 80).collect()) == list(range(0, 80, 2))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 80, 2))


def test_estimate_follows_similarity():
    rng = np.random.default_rng(4)
    for similar in (0.5, 0.85, 0.95):
        n = 2000
        common = rng.integers(0, 2**63, int(n * 2 * similar / (1 + similar)), dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in "ab"]
        sig = bbit_minhash.minima(np.concatenate(sets), np.array([len(s) for s in sets]))
        agree = (sig[0] & 15 == sig[1] & 15).mean()
        assert abs((agree - 1 / 16) / (15 / 16) - similar) < 0.17


def test_near_duplicates_on_edges(docs, clashing, none):
    got = bbit_minhash.near_duplicates(docs).collect()
    assert len(got) == 12
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert by_id[6][0].component_id == 5 and not by_id[6][0].kept and by_id[8][0].component_id == 7
    assert by_id[2][0].kept and by_id[3][0].n_shingles == 0 and by_id[None][0].kept and by_id[None][0].component_id is None
    kept = bbit_minhash.deduplicated(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10]
    assert bbit_minhash.near_duplicates(none).count() == 0 and bbit_minhash.deduplicated(none).count() == 0


def test_chains_of_links_end(spark):
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").unionAll(spark.createDataFrame([(100, 200), (200, 100), (7, 7)], "a long, b long"))
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


# --- mixing ----------------------------------------------------------------------------

def fill(sizes, weights, share=1.5, most=2.0):
    target, left, active = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while active:
        level = left / sum(weights[i] for i in active)
        over = [i for i in active if level * weights[i] > most * sizes[i]]
        if not over:
            for i in active:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            active.remove(i)
    return target


def test_targets_and_words_taken(spark, small):
    got = mixing.taken_words(small).join(small.select("doc_id", "source"), "doc_id").toPandas()
    by = got.groupby("source").agg(size=("size", "sum"), stated=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["stated"]).all()
    assert np.allclose(by["target"], fill(by["size"].tolist(), [(3, 1, 2)[i % 3] for i in range(len(by))]))
    assert (abs(by["taken"] - by["target"]) <= 0.5).all() and (got["taken"] <= 2 * got["size"]).all()


def test_taken_words_follow_from_the_rows_alone(spark, small, monkeypatch):
    """Whatever the files, splits and order, and however small the groups that are drawn and numbered at once."""
    repeats = small.unionByName(small.filter("doc_id < 5")).unionByName(small.filter("doc_id = 3"))
    want = sorted(map(repr, mixing.taken_words(repeats.repartition(1)).collect()))
    assert len(want) == 206 and all(n.n_shards == 0 for n in mixing.taken_words(small).filter("taken = 0").collect())
    monkeypatch.setattr(mixing, "COPIES", 2)
    monkeypatch.setattr(mixing, "SLOTS_AT_ONCE", 7)
    monkeypatch.setattr(mixing, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(mixing, "SLOTS_PER_TASK", 30)
    assert sorted(map(repr, mixing.taken_words(repeats.orderBy(F.desc("n_chars")).repartition(9)).collect())) == want


def test_slots_of_many_groups_of_shards(spark):
    targets = spark.createDataFrame([(0, "a", 40_000, 60_000.0), (1, "b", 1_000, 2_000.0), (2, None, 5, 0.2)], "sid int, source string, source_size long, target double")
    slots = mixing.mixture_slots(targets, block=8, slots_per_shard=40).toPandas()
    assert slots.groupby("sid")["take"].sum().to_dict() == {0: 60_000, 1: 2_000}
    for sid, part in slots.groupby("sid"):
        assert sorted(part["slot"]) == list(range(len(part))) and part["shard"].max() < 200
    sizes = slots.groupby("shard").size()
    assert len(sizes) > 180 and sizes.max() < 100
    first = slots[(slots["sid"] == 0) & (slots["epoch"] == 0)]
    assert sorted(first["idx"]) == list(range(5000))


def test_whole_copies_keep_the_words_of_a_source(spark):
    """Documents of one to thousands of words: each source is off by less than its longest document, and mostly by far less."""
    rng = random.Random(12)
    for share in (0.3, 0.5, 1.0, 1.7, 2.0):
        rows = [(i, i % 7, n, int(n * share)) for i in range(700) for n in [int(rng.lognormvariate(4, 1.2)) + 1]]
        shares = spark.createDataFrame(rows, "_key int, sid int, size long, taken long")
        got = {r._key: r._copies for r in mixing.whole_copies(shares).collect()}
        assert len(got) == 700 and all(taken // size <= got[k] <= -(-taken // size) for k, _, size, taken in rows)
        for sid in range(7):
            mine = [r for r in rows if r[1] == sid]
            assert abs(sum(got[k] * n for k, _, n, _ in mine) - sum(r[3] for r in mine)) <= max(n for _, _, n, _ in mine)


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 100, 1000, 4097):
        for key in (0, 5):
            assert sorted(mixing.permute(np.arange(n), n, key)) == list(range(n))


def test_pieces_cover_whole_documents(spark):
    docs = spark.createDataFrame([(i, "w " * n, "s") for i, n in enumerate((0, 1, 127, 128, 129, 1000))], "doc_id long, text string, source string")
    sized, pieces = mixing.mix(docs)
    words = defaultdict(lambda: defaultdict(int))
    row = {r._row: r.doc_id for r in sized.collect()}
    for p in pieces.collect():
        for i in range(p.first_word, p.first_word + p.n_words):
            words[row[p._row]][i] += 1
    assert sum(sum(x.values()) for x in words.values()) == round(1.5 * 1385)
    assert all(set(words[d]) == set(range(n)) and set(words[d].values()) <= {1, 2} for d, n in ((1, 1), (3, 128), (5, 1000)))


def test_mixing_on_edges(docs, clashing, none):
    got = mixing.taken_words(docs).collect()
    assert len(got) == 12 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (2, 3, 4))
    assert mixing.taken_words(none).count() == 0
    kept = mixing.mixed(clashing)
    assert kept.columns == clashing.columns and not {2, 3, 4} & {r.doc_id for r in kept.collect()}
    assert mixing.mixed(none).count() == 0


# --- chat ------------------------------------------------------------------------------

HARD = ["", None, "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", chat.ESCAPE + "0" + chat.ESCAPE, "<<s>> é\U0001f600", "a\r\nb", "<|im_start|" * 3 + ">"]


def test_escapes_can_be_taken_back():
    template = chat.Template()
    texts = [x or "" for x in HARD]
    rng = random.Random(0)
    texts += ["".join(rng.choice([*chat.CONTROLS, chat.ESCAPE, "<", "[", "s>", "A", "0"]) for _ in range(12)) for _ in range(200)]
    for text, out in zip(texts, template.escaped(pa.array(texts)).to_pylist()):
        assert template.unescaped(out) == text and not any(c in out for c in chat.CONTROLS)


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_conversations_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROWS_HELD", 50)
    rng = random.Random(9)
    roles = ["user", "assistant", "system", None, "as\nsistant"]
    rows = [(c, t, rng.choice(roles), rng.choice(HARD)) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(99, t, roles[t % 2], f"turn {t} " + HARD[2]) for t in range(500)] + [(98, None, "user", str(i)) for i in range(300)]
    rows += [(None, 0, "user", "no id"), (97, 0, "user", "x" * 2_000_000), (97, 0, "user", "tie"), (97, 0, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        formatted = stage(chat.format_conversations(turns), "chat")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert formatted.filter("conv_id = 98").count() > 1
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(formatted).collect()}
    assert got == expected(rows)
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


# --- shards ----------------------------------------------------------------------------

def sharded(df, n=8):
    return shards.shard(df, F.xxhash64("text", F.col("text").isNull()), F.col("doc_id"), shards.row_size(), n)


def test_shards_are_even_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharded(docs).withColumn("size", shards.row_size()).toPandas()
    assert sorted(got["doc_id"]) == list(range(1000))
    for _, rows in got.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= got["size"].max()
    assert (got.groupby("text")["shard"].nunique() == 1).all()


def test_hot_texts_and_hot_nulls_are_divided(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot text' WHEN id % 3 = 1 THEN NULL ELSE concat('t', id, repeat('x', 200)) END AS text")
    got = sharded(rows).withColumn("size", shards.row_size()).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() < 1.05 * sizes.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_on_edges(clashing, none, docs):
    got = sharded(clashing)
    assert sorted(got.columns) == sorted(clashing.columns) and got.count() == 12
    assert {r.shard for r in got.collect()} <= set(range(8))
    assert sharded(none).count() == 0
    assert {r.shard for r in sharded(docs, 1).collect()} == {0}


# --- archives --------------------------------------------------------------------------

def test_archives_round_trip(spark):
    same = "<p>é same</p>" * 100
    rows = [(1, "http://a/", same), (2, "http://b/\r\nX: y", same), (3, None, same), (4, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (5, "u", None), (6, "u", ""),
            (7, "u", "small"), (8, "u", "small"), (9, "u", "x" * 3_000_000), (None, "u", "no id"), (9, "u", "x" * 3_000_000), (None, "n", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = scratch_dir(spark, "warc")
    warc.write_archives(pages, path)
    records = stage(warc.read_archives(spark, path), "records")
    assert records.groupBy("type").count().collect() and records.count() == 3 * len(rows)
    got = [r.capture.asDict() | {"sides": (len(r.requests), len(r.metadata))} for r in warc.assemble_transactions(records).collect()]
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h in rows if p == r["page_id"] and (p is not None or (r["refers_to_page"] is None) == (h == "no id"))) or ""
        assert r["stated_digest"] == hashlib.sha1(html.encode()).hexdigest() and r["stated_bytes"] == len(html.encode())
        if html == same and r["page_id"] != 3:
            assert (r["type"], r["refers_to_page"], bytes(r["payload"])) == ("revisit", 3, b"")
        else:
            assert (r["type"], r["refers_to_page"], bytes(r["payload"])) == ("response", None, html.encode())
        assert r["sides"] == ((2, 2) if r["page_id"] == 9 else (1, 1))


def test_orphans_and_empty_archives(spark):
    records = spark.createDataFrame([("request", "<r1>", "<gone>", None), ("response", "<a>", None, None), ("metadata", "<m>", "<a>", None)],
                                    "type string, record_id string, concurrent_to string, refers_to string")
    got = {r.capture_id: r for r in warc.assemble_transactions(records).collect()}
    assert got["<gone>"].capture is None and len(got["<gone>"].requests) == 1
    assert got["<a>"].capture.record_id == "<a>" and len(got["<a>"].metadata) == 1
    path = scratch_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble_transactions(warc.read_archives(spark, path)).count() == 0


def test_mix_of_whole_documents_keeps_the_words_of_a_source(spark):
    """Long documents of a source all lie near one ratio; they are not lost or kept together."""
    rng = random.Random(6)
    sizes = {"a": [500] * 300 + [5000] * 120 + [20000] * 40, "b": [400] * 900, "c": [rng.randrange(3000, 9000) for _ in range(150)]}
    rows = [(f"{s}{i}", n, s) for s, all_sizes in sizes.items() for i, n in enumerate(all_sizes)]
    rows = [(k, n, s) for k, (_, n, s) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string").selectExpr("doc_id", "concat_ws(' ', sequence(1, n)) AS text", "source", "n")
    got = mixing.mixed(docs).groupBy("source").agg(F.sum("n").alias("n")).toPandas().set_index("source")["n"]
    want = mixing.taken_words(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("target").alias("target"))
    for r in want.collect():
        assert abs(got[r.source] - r.target) <= 0.02 * r.target + 20000, r
    # Each length of the source keeps its share.
    share = {r.n: r.m / r.k for r in mixing.mixed(docs.filter("source <> 'c'")).filter("source = 'a'").groupBy("n").agg(F.count("*").alias("m"))
             .join(docs.filter("source = 'a'").groupBy("n").agg(F.count("*").alias("k")), "n").collect()}
    assert set(share) == {500, 5000, 20000} and max(share.values()) - min(share.values()) < 0.1 * max(share.values()), share


def test_archives_are_cut_by_bytes(spark):
    rows = [(i, "u", "x" * n) for i, n in enumerate([10] * 9 + [500] * 5 + [5000] * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch_dir(spark, "warc")
    warc.write_archives(pages, path, ((100, 4), (1000, 2), (2**40, 1)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()
    count = {most: sum(f"upto={most}/" in r.path for r in files) for most in (100, 1000, 2**40)}
    assert count == {100: 3, 1000: 3, 2**40: 3}
    records = warc.read_archives(spark, path).filter("type IN ('response', 'revisit')")
    assert sorted(r.page_id for r in records.collect()) == list(range(17))
    small = scratch_dir(spark, "warc")
    warc.write_archives(pages.filter("page_id < 9"), small)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(small).filter("path LIKE '%upto=65536/%'").count() > 0


def _warc(kind, block, **headers):
    named = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{named}".encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_damaged_archives_are_rows(spark, tmp_path):
    http = {"Content_Type": "application/http; msgtype=response"}
    good = [_warc("response", b"HTTP/1.1 200 OK\r\n\r\nbody%d" % i, WARC_Page_ID=i, **http) for i in range(4)]
    headless = _warc("response", b"no header here", WARC_Page_ID="seven", **http)
    lengthless = good[1].replace(b"Content-Length", b"Content-Height")
    (tmp_path / "a.warc").write_bytes(good[0] + headless + lengthless + good[2] + b"junk\nWARC/9\r\n" + good[3][:-8])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good[0]) + gzip.compress(good[1]) + gzip.compress(good[2])[:-9])
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(b"not an archive \xff")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    told = sorted((r.error or "", r.page_id if r.page_id is not None else -1, bytes(r.payload)[:9]) for r in got)
    assert [t for t in told if not t[0]] == [("", 0, b"body0"), ("", 0, b"body0"), ("", 1, b"body1"), ("", 2, b"body2")]
    assert [t[:2] for t in told if t[0]] == [("cut off", 3), ("damaged gzip member", -1), ("no HTTP header", -1)] + [("no record", -1)] * 3
    assert any(bytes(r.payload) == b"no header here" and r.type == "response" for r in got)
    assert any(bytes(r.payload).startswith(b"WARC/1.1") and r.type is None for r in got)


def test_sides_that_name_no_capture_stay_apart(spark):
    records = spark.createDataFrame([("request", f"<r{i}>", None) for i in range(5)] + [("metadata", "<m>", None), (None, "<x>", None)],
                                    "type string, record_id string, concurrent_to string")
    got = warc.assemble_transactions(records.withColumn("refers_to", F.lit(None).cast("string"))).collect()
    assert sorted((len(r.requests), len(r.metadata)) for r in got) == [(0, 1)] + [(1, 0)] * 5
    assert all(r.capture is None and r.capture_id is None for r in got)

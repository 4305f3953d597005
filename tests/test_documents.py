import random
from collections import Counter

from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.operators import assemble as asm
from pagewright.operators import inference as inf
from pagewright.operators import keywords as kw
from pagewright.operators import language as lg
from pagewright.operators import pages as pg
from pagewright.operators import requests as rq
from pagewright.operators.extractive import extractive_summary
from pagewright.operators.joins import hot_keys, salted_lookup

PAGES = "doc_id string, page_no long, text string"


def kept(spark, texts):
    rows = spark.createDataFrame([("d", n, t) for n, t in enumerate(texts)], PAGES)
    return [r.meaningful for r in pg.classify_pages(rows).orderBy("page_no").collect()]


def test_page_length_thresholds(spark):
    three = "a b c d e\n" * 2
    latin = [three + "a b c d " + "e" * (n - 28) for n in (119, 120)]
    assert [len(t) for t in latin] == [119, 120]
    han = [("漢" * 8 + "\n") * 2 + "漢" * (n - 18) for n in (59, 60)]
    assert kept(spark, latin + han) == [False, True, False, True]


def test_page_needs_prose(spark):
    two = "a b c d e f g h i j k l m n o p q r s t u v w x y z\n" * 2 + "short\n" * 20
    assert kept(spark, [two, two + "now a third line here", "References\n" + two + "now a third line here"]) == [False, True, False]
    prose = "a b c d e\n" * 3  # 29 characters when joined
    shares = [prose + "w" * (n - len(prose)) for n in (120, 150)]
    assert kept(spark, shares) == [False, False]
    prose = "aaa bbb ccc ddd e\n" * 3  # 53 characters when joined
    assert kept(spark, [prose + "w" * (n - len(prose)) for n in (151, 152)]) == [True, False]


def test_chinese_short_lines_survive(spark):
    page = "\n".join(["姓名王小明", "電話", "專長", "負責資料平台的設計與開發工作", "曾經主持大型系統的移轉專案計畫",
                      "熟悉分散式運算與資料庫調校技術", "興趣", "12", "登山與攝影"] * 2)
    row = pg.classify_pages(spark.createDataFrame([("d", 0, page)], PAGES)).first()
    assert row.meaningful and "電話" in row.clean and "\n12\n" not in row.clean


def test_ocr_fills_nearly_empty_pages(spark):
    pages = spark.createDataFrame([("d", 0, " ab "), ("d", 1, "x" * 40), ("d", 2, "abc"), ("d", 3, "")], PAGES)
    lines = spark.createDataFrame(
        [("d", 0, 1, "two", 0.9), ("d", 0, 0, "one", 0.9), ("d", 0, 2, None, 0.1), ("d", 1, 0, "y" * 90, 0.9), ("d", 2, 0, "abd", 0.9)],
        "doc_id string, page_no long, line_no long, text string, score double")
    got = pg.merge_ocr(pages, pg.assemble_ocr(lines)).orderBy("page_no").collect()
    assert [r.text for r in got] == ["one\ntwo", "x" * 40, "abc", ""]
    assert [r.text for r in pg.merge_ocr(pages, None).orderBy("page_no").collect()] == ["ab", "x" * 40, "abc", ""]
    assert pg.ocr_candidates(pages).count() == 3


def test_keyword_order_and_weights(spark):
    texts = spark.createDataFrame([("d", 1, "beta alpha"), ("d", 0, "zeta beta the Alpha zeta"), ("e", 0, "the and")],
                                  "doc_id string, ord int, text string")
    got = kw.frequency_keywords(texts).orderBy("rank").collect()
    assert [(r.word, r.weight) for r in got] == [("zeta", 1.0), ("beta", 1.0), ("alpha", 1.0)]


def test_wide_ordinals_keep_the_order(spark):
    big = 5_000_000_000
    texts = spark.createDataFrame([("d", big + 1, "alpha"), ("d", big, "omega")], "doc_id string, ord long, text string")
    assert [r.word for r in kw.frequency_keywords(texts).orderBy("rank").collect()] == ["omega", "alpha"]


def test_weights_round_like_python(spark):
    pairs = [(c, t) for t in (3, 7, 32, 96, 160, 480, 800, 4000, 20000, 60000) for c in range(1, min(t, 700) + 1)]
    df = spark.createDataFrame(pairs, "c long, t long")
    for r in df.withColumn("w", kw.ratio_4_digits(F.col("c"), F.col("t"))).collect():
        assert r.w == round(r.c / r.t, 4), (r.c, r.t)


def test_top_k_against_counter(spark):
    rng = random.Random(3)
    vocabulary = ["w" + a + b for a in "abcdefgh" for b in "abcdefgh"]
    rows = [("hot" if i % 3 else f"d{i}", i, " ".join(rng.choices(vocabulary, k=30))) for i in range(60)]
    got = kw.frequency_keywords(spark.createDataFrame(rows, "doc_id string, ord int, text string"), 10)
    by_doc = {}
    for r in got.orderBy("doc_id", "rank").collect():
        by_doc.setdefault(r.doc_id, []).append(r.word)
    for doc, words in by_doc.items():
        counts = Counter(w for d, _, t in rows if d == doc for w in t.split())
        assert words == [w for w, _ in counts.most_common(10)]


def test_tfidf_uses_the_same_idf_for_frequent_and_rare_terms(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"d{i}", 0, " ".join(["common"] + rng.choices(["rare" + c for c in "abcdefghij"], k=5))) for i in range(30)]
    texts = spark.createDataFrame(rows, "doc_id string, ord int, text string")

    def scores():
        return sorted(map(tuple, kw.tfidf_keywords(texts, 5).collect()))

    everything_hot = scores()
    monkeypatch.setattr(kw, "MAX_BROADCAST_TERMS", 1)  # nothing is hot
    assert scores() == everything_hot


def test_chinese_documents_get_han_pairs(spark):
    texts = spark.createDataFrame([("zh", 0, "資料平台 資料 Spark"), ("en", 0, "Spark spark data")], "doc_id string, ord int, text string")
    languages = spark.createDataFrame([("zh", "zh"), ("en", "en")], "doc_id string, language string")
    got = {(r.doc_id, r.word) for r in kw.extract_keywords(texts, languages).collect()}
    assert {("zh", "資料"), ("zh", "平台"), ("zh", "spark"), ("en", "spark"), ("en", "data")} <= got


def test_wordcloud_terms(spark):
    rows = [("d", 1, "a", 1.0), ("d", 2, "b", 0.0), ("d", 3, "a", 0.5), ("d", 4, "c", 0.25), ("e", 1, "x", -1.0)]
    got = kw.wordcloud_terms(spark.createDataFrame(rows, "doc_id string, rank int, word string, weight double"))
    assert sorted(map(tuple, got.collect())) == [("d", "a", 0.5, 1.0), ("d", "c", 0.25, 0.5)]


def test_language_model_agrees_with_and_without_broadcast(spark, monkeypatch):
    labelled = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der Hund und die Katze"), ("fr", "le chien et le chat")],
                                     "lang string, text string")
    texts = spark.createDataFrame([("a", "the dog"), ("b", "und der"), ("c", "le chat"), ("d", "zz"), ("e", "")], "doc_id string, text string")
    profile = lg.train_profile(labelled).cache()
    hot = sorted(map(tuple, lg.classify(texts, profile).collect()))
    assert [(d, lang) for d, lang, _ in hot] == [("a", "en"), ("b", "de"), ("c", "fr"), ("d", None), ("e", None)]
    monkeypatch.setattr(lg, "MAX_BROADCAST_GRAMS", 1)
    assert sorted(map(tuple, lg.classify(texts, profile).collect())) == hot


def test_detected_language_falls_back_to_english(spark):
    chunks = spark.createDataFrame([("zh", 0, "漢字文件"), ("x", 0, "12 34"), ("fr", 0, "le chat"), ("fr", 1, "le chien")],
                                   "doc_id string, index int, original string")
    scripts = lg.document_scripts(chunks.select("doc_id", F.col("original").alias("text")))
    profile = lg.train_profile(spark.createDataFrame([("fr", "le chat le chien")], "lang string, text string")).cache()
    heads = lg.document_heads(chunks, 2000)
    assert {r.doc_id: r.text for r in heads.collect()}["fr"] == "le chat\nle chien"
    open_ = lg.undecided(scripts, chunks)
    assert sorted(r.doc_id for r in open_.collect()) == ["fr", "fr", "x"]
    got = dict(map(tuple, lg.detect_language(scripts, lg.classify(open_.filter("doc_id != 'x'"), profile)).collect()))
    assert got == {"zh": "zh", "x": "en", "fr": "fr"}
    assert dict(map(tuple, lg.detect_language(scripts).collect())) == {"zh": "zh", "x": "en", "fr": "en"}


def test_salted_lookup_equals_a_join(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(300)], "id int, key string")
    dim = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3), ("unused", 4)], "key string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = facts.join(dim, "key", how)
        got = salted_lookup(facts, dim, "key", F.col("id"), how, max_hot=4)
        assert sorted(got.select(want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    counts = facts.groupBy("key").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "n", facts.agg(F.count("*").alias("t")), 4).collect()
    assert [r.key for r in hot] == ["hot"]


def test_requests(spark):
    chunks = spark.createDataFrame([("d", 0, "Text one. Two."), ("d", 1, "x" * 5000)], "doc_id string, index int, original string")
    first = rq.summary_requests(chunks).orderBy("index").first()
    assert first.messages[1].content == fv.SUMMARY_PREFIX + "Text one. Two." and first.max_tokens == 900
    wins = rq.translation_requests(chunks, "jpn_Jpan").orderBy("index").collect()
    assert "日本語" in wins[0].messages[0].content and [w.max_tokens for w in wins] == [514, 2048]
    sample = rq.sample_requests(chunks).orderBy("index").collect()
    assert [s.max_tokens for s in sample] == [407, 1150] and len(sample[1].messages[1].content) == 1500
    assert pg.first_chunks(chunks, 1).count() == 1 and pg.first_chunks(chunks, 0).count() == 2


def test_every_summary_reaches_the_overview(spark):
    rows = spark.createDataFrame([("d", i, f"s{i}") for i in (2, 0, 1)], "doc_id string, index int, text string")
    whole = rq.overview_requests(rows).collect()
    assert len(whole) == 1
    body = "[段落 1]\ns0\n\n[段落 2]\ns1\n\n[段落 3]\ns2"
    assert whole[0].messages[1].content == fv.OVERVIEW_PREFIX + body
    parts = rq.overview_requests(rows, per_prompt=2).orderBy("index").collect()
    assert [p.messages[1].content for p in parts] == [fv.OVERVIEW_PREFIX + x for x in ("[段落 1]\ns0\n\n[段落 2]\ns1", "[段落 3]\ns2")]

    many = spark.range(1500).selectExpr("'long' AS doc_id", "id AS index", "concat('s', id) AS text").unionByName(
        spark.createDataFrame([("bad", 0, "s0"), ("bad", 5, "broken"), ("short", 0, "s0")], "doc_id string, index long, text string"))

    def ask(asked):
        said = F.col("messages")[1]["content"]
        error = F.when(said.contains("broken"), "no answer")
        return asked.select("doc_id", "index", F.when(error.isNull(), said).alias("text"), error.alias("error"))

    said, failed = rq.overview_levels(many, ask, per_prompt=10)
    got = {r.doc_id: r.text for r in said.collect()}
    assert set(got) == {"long", "short"} and all(f"\ns{i}" in got["long"] for i in (0, 9, 10, 777, 1499))
    assert [tuple(r) for r in failed.collect()] == [("bad", "no answer")]


def test_a_translator_of_the_wrong_length_is_an_error(spark):
    chunks = spark.createDataFrame([("d", 0, "One. Two. Three.")], "doc_id string, index int, original string")
    out = inf.run_batches(rq.sentence_requests(chunks, F.lit("eng_Latn")), lambda: lambda texts, source: texts[1:], tasks=1).collect()
    assert len(out) == 3 and all(r.text is None and "for" in r.error for r in out)


def test_inference_records_failures(spark):
    def factory():
        def client(system, user, max_tokens, temperature):
            if "bad" in user:
                raise RuntimeError("no answer")
            return f"<think>hm</think> {user.upper()} ", len(user)
        return client

    chunks = spark.createDataFrame([("d", 0, "One. Two."), ("e", 0, "bad text.")], "doc_id string, index int, original string")
    out = {r.doc_id: r for r in inf.run_inference(rq.translation_requests(chunks), factory, 2).collect()}
    assert (out["d"].text, out["d"].completion_tokens, out["d"].error) == ("ONE. TWO.", 9, None)
    assert (out["e"].text, out["e"].error) == (None, "no answer") and out["e"].elapsed >= 0
    merged = {r.doc_id: r for r in inf.merge_translations(inf.run_inference(rq.translation_requests(chunks), factory)).collect()}
    assert merged["d"].text == "ONE. TWO." and merged["e"].error == "no answer"


def test_extractive_summary_keeps_the_richest_sentences(spark):
    texts = spark.createDataFrame([("d", 0, "Nothing here. Spark data wins. Data only. Filler words follow. Spark.")],
                                  "doc_id string, index int, original string")
    keywords = spark.createDataFrame([("d", 1, "spark", 1.0), ("d", 2, "data", 0.5)], "doc_id string, rank int, word string, weight double")
    got = extractive_summary(texts, keywords, 2).first().summary
    assert got == "Spark data wins. Spark."


def test_segments_and_report(spark):
    chunks = spark.createDataFrame([("d", 1, "second"), ("d", 0, "first & last")], "doc_id string, index int, original string")
    summaries = spark.createDataFrame([("d", 0, "sum")], "doc_id string, index int, text string")
    segments = asm.assemble_segments(chunks, summaries)
    nested = asm.nest_segments(segments, per_row=10).first()
    assert [(s["index"], s.summary) for s in nested.segments] == [(0, "sum"), (1, None)]
    assert asm.nest_segments(segments, per_row=1).count() == 2

    overview = "struct<conclusion:string,data:string,risk:string,action:string,raw:string>"
    results = spark.createDataFrame([("d", 3, 2, "en", ("", "n < 1", "", "", "raw"), "data:image/png;base64,AA==")],
                                    f"doc_id string, total_pages int, n_chunks int, language string, global_summary {overview}, wordcloud_image_url string")
    rows = asm.report_rows(results, segments).orderBy("section", "index", "ord").collect()
    assert [(r.kind, r.text) for r in rows] == [
        ("title", fv.REPORT_TITLE), ("meta", "共 3 頁　·　語言：en　·　有效段落 2"), ("heading", "全局重點"),
        ("tag", "關鍵數據"), ("body", "n &lt; 1"), ("heading", "關鍵字文字雲"), ("image", "data:image/png;base64,AA=="),
        ("heading", "逐段對照"),
        ("segment", "段落 1"), ("tag", "摘要"), ("body", "sum"), ("tag", "原文"), ("original", "first &amp; last"),
        ("segment", "段落 2"), ("note", fv.REPORT_NOTHING), ("tag", "原文"), ("original", "second")]
    raw_only = results.withColumn("global_summary", F.struct(*[F.lit("").alias(p) for p in fv.PARTS], F.lit("raw").alias("raw")))
    kinds = [(r.kind, r.text) for r in asm.report_rows(raw_only, segments).filter("section = 0").orderBy("ord").collect()]
    assert ("body", "raw") in kinds and ("heading", "全局重點") in kinds

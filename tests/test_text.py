import random
import sys

import pytest
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import codes, replies
from pagewright.functions import report as rp
from pagewright.functions import text as tx

JUNK = "12\n１２\nIntro ..... 7\n[34] Smith\n[34]\nx\n\na b c d e"


def test_whitespace_is_what_python_calls_whitespace(one):
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    assert sorted(fv.WHITESPACE) == blanks
    assert one(tx.strip, ["".join(blanks) + "a b" + "".join(blanks)]) == ["a b"]
    assert one(tx.dense_len, ["a" + b + "b" for b in blanks]) == [2] * len(blanks)


def test_line_breaks_are_those_of_splitlines(one):
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    assert one(tx.lines, [f"a{b}b" for b in breaks]) == [["a", "b"]] * len(breaks)
    assert one(tx.lines, "a\x1fb") == ["a\x1fb"]


def test_junk_lines_go(one):
    assert one(tx.content_lines, JUNK) == ["[34]", "a b c d e"]
    assert one(tx.prose_lines, JUNK) == ["a b c d e"]
    assert one(tx.content_lines, ["", "  \n\t"]) == [[], []]


def test_sentence_like_counts_han_or_words(one):
    assert one(tx.is_sentence_like, ["漢" * 7, "漢" * 8, "a b c d", "a b c d e"]) == [False, True, False, True]


def test_skip_headings(one):
    heads = ["References\nx", "CONTENTS  \nfoo", "Acknowledgements", "目錄\n1", "References to X", "acknowledgment \x0b y"]
    assert one(tx.has_skip_heading, heads) == [True, True, True, True, False, True]


def test_script(one):
    cv = "個人簡歷 Python Spark SQL 工程師 五年經驗"
    texts = [cv, "の" + "漢" * 40, "한국어 문서입니다 漢字", "plain English", "", " \n"]
    assert one(tx.script_language, texts) == ["zh", "ja", "ko", None, None, None]
    assert one(tx.cjk_ratio, ["", "漢a b字"]) == [0.0, 0.5]


def test_sentences(one):
    texts = ["a. b! c。 d", "v1.2 is.", "Ok?no", "\n \n", " One.  Two!\n\n three \r\nfour.\t"]
    assert one(tx.sentences, texts) == [["a.", "b!", "c。", "d"], ["v1.2 is."], ["Ok?no"], [], ["One.", "Two!", "three", "four."]]


def test_words_drop_stop_words_and_keep_hyphens(one):
    assert one(tx.words, "The State-of-the-art ab ABC x-y-z- été café") == ["state-of-the-art", "abc", "x-y-z-", "caf"]
    assert len(set(fv.STOP_WORDS)) == len(fv.STOP_WORDS) == 101


def test_grams_overlap_and_keep_pairs_together(one):
    assert one(lambda t: tx.grams(t, 3), ["ab😀cd", "ab", ""]) == [["ab😀", "b😀c", "😀cd"], [], []]
    assert one(tx.han_bigrams, "漢字表x一 二三") == ["漢字", "字表", "二三"]


def test_think_blocks(one):
    texts = ["<think>a</think> b ", "<THINK>x\ny</Think>c<think>z</think>d", "<think>open", "plain"]
    assert one(replies.strip_think, texts) == ["b", "cd", "<think>open", "plain"]


def test_overview_parts(one):
    raw = "preface\n# 1. 結論：\n\n**風險 / 限制**\nrisky\n- 結論\nfine\nmore\n結論\nlate\n總結\n行動建議\n "
    got = one(replies.parse_overview, [raw, "no headings", ""])
    assert got[0].asDict() == {"conclusion": "fine\nmore", "data": "", "risk": "risky", "action": "", "raw": raw}
    assert [got[1][p] for p in fv.PARTS] == [""] * 4 and got[1]["raw"] == "no headings"
    assert got[2]["raw"] == ""


def test_headings_in_running_text_do_not_cut(one):
    assert one(replies.heading_part, ["結論", "## 結論 :", "結論是", "關鍵數據（1）", "", "----"]) == [
        "conclusion", "conclusion", None, "data", None, None]


def test_clip(one):
    body = "x" * 700
    assert one(rp.clip_sentence, [None, " " + body + "\n", body + "y"]) == ["", body, body + " …"]
    early, late = "a" * 340 + ". " + "b" * 500, "a" * 400 + ". " + "b" * 500
    assert one(rp.clip_sentence, [early, late]) == [early[:700] + " …", "a" * 400 + ". …".replace(". ", ". ")]
    mixed = "a" * 400 + "。" + "b" * 100 + "! " + "c" * 400
    assert one(rp.clip_sentence, mixed) == "a" * 400 + "。 …"


def test_markup_and_views(one, spark):
    assert one(rp.markup, ["a<b>&\nc", None]) == ["a&lt;b&gt;&amp;<br/>c", ""]
    rows = spark.createDataFrame([("s", "t", "o"), ("", "t", "o"), (None, "", "o")], "s string, t string, o string")
    shown = rows.select(rp.default_view(F.col("s"), F.col("t"), F.col("o")).alias("v")).collect()
    assert [r.v for r in shown] == ["s", "t", "o"]


def test_codes(one):
    assert one(codes.iso_of, ["zho_Hant", "fra_Latn", "xxx_Latn"]) == ["zh", "fr", "xxx"]
    assert one(codes.model_code_of, ["zh", "xx"]) == ["zho_Hans", "eng_Latn"]
    assert one(codes.display_name, ["kor_Hang", "fra_Latn"]) == ["한국어", "fra_Latn"]
    assert one(lambda c: codes.source_code(c, "deu_Latn"), ["fr", "xx", None]) == ["fra_Latn", "deu_Latn", "deu_Latn"]
    assert one(lambda c: codes.already_target(c, "zho_Hant"), ["zh", "en", None]) == [True, False, False]


def test_cache_key_and_flags(spark):
    df = spark.createDataFrame([(" b, a,,a",)], "f string")
    key = codes.cache_key(F.lit("h"), F.lit("qwen"), F.lit("zho_Hant"), F.col("f"))
    assert df.select(key.alias("k")).first().k == "h|qwen|zho_Hant|a,a,b"
    extended = codes.cache_key(F.lit("h"), F.lit("q"), F.lit("t"), F.col("f"), F.lit("cfg"))
    assert df.select(extended.alias("k")).first().k == "h|q|t|a,a,b|cfg"
    flags = codes.feature_flags(F.lit("nosummary"))
    row = df.select(*[c.alias(n) for n, c in flags.items()]).first()
    assert (row.do_summary, row.do_report) == (True, False)


def test_upload_checks(spark):
    rows = spark.createDataFrame([(0, "x.txt"), (11, "x.txt"), (5, "X.PDF"), (5, "x.txt"), (5, None)], "n long, f string")
    got = [r.s for r in rows.select(codes.upload_status(F.col("n"), F.col("f"), 10).alias("s")).collect()]
    assert got == [400, 413, None, 415, 415]


def test_traditional_prefers_long_phrases(one):
    table, phrases = {"发": "發", "头": "頭"}, {"头发": "頭髮", "头": "首"}
    assert one(lambda c: replies.to_traditional(c, table, phrases), ["头发", "发头", "x"]) == ["頭髮", "發首", "x"]
    kept = {"皇后": "皇后"}
    assert one(lambda c: replies.to_traditional(c, {"后": "後", "来": "來"}, kept), ["皇后来了", "后来", None, ""]) == ["皇后來了", "後來", None, ""]


def test_image_uri_round_trip(one):
    data = bytes(range(256)) * 3
    uri = one(codes.image_uri, bytearray(data), "binary")
    assert uri.startswith("data:image/png;base64,") and "\n" not in uri and "\r" not in uri
    assert bytes(one(codes.image_bytes, uri)) == data
    assert one(codes.image_bytes, "http://x/y.png") is None


@pytest.mark.parametrize("seed", range(3))
def test_sentence_split_loses_only_blanks(one, seed):
    random.seed(seed)
    texts = ["".join(random.choices("ab.!?。 \n\r\t　\x1c漢", k=60)) for _ in range(40)]
    got = one(tx.sentences, texts)
    for text, parts in zip(texts, got):
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert all(p == p.strip() and p for p in parts)
        assert sum(len(line.split()) > 0 for line in text.splitlines()) <= len(parts)

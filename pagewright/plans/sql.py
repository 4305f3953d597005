"""SQL building blocks of the oracles (DuckDB), written independently of the Spark expressions."""

from __future__ import annotations

from .. import fixed_values as fv
from ..operators import hashed_language as hl

WS = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LB = r"\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}"
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
KANA = r"\x{3040}-\x{30FF}"
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"
CJK = HAN + KANA + r"\x{AC00}-\x{D7AF}"
NL = "chr(10)"


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def lines(x: str) -> str:
    return f"string_split_regex({x}, '\\r\\n|[{LB}]')"


def dense(x: str) -> str:
    return f"length(regexp_replace({x}, '[{WS}]', '', 'g'))"


def count(x: str, char_class: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '[{char_class}]', '', 'g')))"


def cjk_ratio(x: str) -> str:
    return f"(CASE WHEN {dense(x)} > 0 THEN {count(x, CJK)} / {dense(x)} ELSE 0.0 END)"


def script(d: str, han: str, kana: str, hangul: str) -> str:
    return (
        f"CASE WHEN {d} = 0 THEN NULL WHEN {kana} / {d} >= 0.02 THEN 'ja' "
        f"WHEN {hangul} > {han} AND {hangul} / {d} >= 0.05 THEN 'ko' WHEN {han} / {d} >= 0.05 THEN 'zh' END"
    )


def content(x: str) -> str:
    return (
        f"list_filter(list_transform({lines(x)}, lambda l: {strip('l')}), lambda s: length(s) >= 2 "
        f"AND NOT regexp_matches(s, '^\\p{{Nd}}+$') AND NOT regexp_matches(s, '\\.{{4,}}[{WS}]*\\p{{Nd}}+$') "
        f"AND NOT regexp_matches(s, '^\\[\\p{{Nd}}+\\][{WS}]'))"
    )


def sentence_like(s: str) -> str:
    words = f"len(list_filter(string_split_regex({s}, '[{WS}]+'), lambda w: w <> ''))"
    return f"({count(s, CJK)} >= 8 OR {words} >= 5)"


def sentence_list(x: str) -> str:
    cut = f"string_split(regexp_replace({strip('l')}, '([.!?。！？])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))"
    return (
        f"list_filter(list_transform(flatten(list_transform({lines(x)}, lambda l: {cut})), "
        f"lambda s: {strip('s')}), lambda s: s <> '')"
    )


def numbered(column: str, source: str, keys: str, name: str, no: str) -> str:
    """Unnest a list column with 0-based positions."""
    return (
        f"SELECT {keys}, CAST(i - 1 AS INTEGER) AS {no}, {column}[i] AS {name} "
        f"FROM (SELECT {keys}, {column}, unnest(range(1, len({column}) + 1)) AS i FROM {source})"
    )


def words(x: str) -> str:
    stop = ", ".join(text(w) for w in fv.STOP_WORDS)
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z\\-]{{2,}}'), lambda w: lower(w)), "
        f"lambda w: w NOT IN ({stop}))"
    )


def four_digits(part: str, whole: str) -> str:
    """part/whole to 4 digits by the exact binary value of the quotient."""
    x = f"({part} / {whole})"
    k = f"(({part} * 20000) // {whole})"
    high = f"CAST(floor({x} * 67108864) AS HUGEINT)"
    low = f"CAST(({x} - {high} / 67108864.0::DOUBLE) * 1180591620717411303424.0::DOUBLE AS HUGEINT)"
    side = f"(({high} * 20000 - {k}::HUGEINT * 67108864) * 17592186044416 + {low} * 20000)"
    below = f"(({k} - 1) // 2)"
    return (
        f"(CASE WHEN ({part} * 20000) % {whole} = 0 AND {k} % 2 = 1 THEN "
        f"({below} + CASE WHEN {side} > 0 OR ({side} = 0 AND {below} % 2 = 1) THEN 1 ELSE 0 END) / 10000.0::DOUBLE "
        f"ELSE round_even({x}::DOUBLE, 4) END)"
    )


def classified(source: str) -> str:
    """CTEs ``classified``: pages of ``source`` (doc_id, page_no, text) with meaningful and clean."""
    heads = "|".join(fv.SKIP_HEADINGS)
    return f"""
    body AS (SELECT doc_id, page_no, {strip('text')} AS b FROM {source}),
    marked AS (SELECT *, {cjk_ratio('b')} >= 0.2 AS cjk, {content('b')} AS c FROM body),
    prose AS (SELECT *, list_filter(c, lambda s: {sentence_like('s')}) AS p FROM marked),
    classified AS (SELECT doc_id, page_no,
        length(b) >= CASE WHEN cjk THEN 60 ELSE 120 END
        AND NOT regexp_matches({lines('b')}[1], '^[{WS}]*({heads})[{WS}]*$', 'i')
        AND len(p) >= 3
        AND length(array_to_string(p, ' ')) >= length(b) * CASE WHEN cjk THEN 0.2 ELSE 0.35 END AS meaningful,
        array_to_string(CASE WHEN cjk THEN c ELSE p END, {NL}) AS clean
      FROM prose)"""


def packed(source: str, limit: int = 6000) -> str:
    """CTEs ``chunks`` (doc_id, idx, original) from pages of ``source``."""
    return f"""
    ordered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS rn, text,
                       length(text) AS z FROM {source} WHERE text <> ''),
    walk AS (SELECT doc_id, rn, z AS buf, 0::BIGINT AS idx FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.doc_id, o.rn, CASE WHEN w.buf + o.z > {limit} THEN o.z ELSE w.buf + 2 + o.z END,
               CASE WHEN w.buf + o.z > {limit} THEN w.idx + 1 ELSE w.idx END
        FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1),
    chunks AS (SELECT doc_id, idx, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS original
        FROM walk JOIN ordered USING (doc_id, rn) GROUP BY doc_id, idx)"""


def window_walk(source: str, limit: int = 1400) -> str:
    """CTEs ``wins`` (doc_id, win_idx, win) from ``source`` (doc_id, text)."""
    return f"""
    sent_lists AS (SELECT doc_id, text, {sentence_list('text')} AS ss FROM {source}),
    sents AS ({numbered('ss', 'sent_lists', 'doc_id', 's', 'rn')}),
    wwalk AS (SELECT doc_id, rn, length(s) AS buf, 0 AS win_idx FROM sents WHERE rn = 0
        UNION ALL
        SELECT n.doc_id, n.rn, CASE WHEN w.buf + length(n.s) + 1 > {limit} THEN length(n.s) ELSE w.buf + 1 + length(n.s) END,
               CASE WHEN w.buf + length(n.s) + 1 > {limit} THEN w.win_idx + 1 ELSE w.win_idx END
        FROM wwalk w JOIN sents n ON n.doc_id = w.doc_id AND n.rn = w.rn + 1),
    wins AS (SELECT doc_id, win_idx, string_agg(s, ' ' ORDER BY rn) AS win
        FROM wwalk JOIN sents USING (doc_id, rn) GROUP BY doc_id, win_idx
        UNION ALL SELECT doc_id, 0, text FROM sent_lists WHERE len(ss) = 0 AND {strip('text')} <> '')"""


def profile_scores(trained: str, scored: str) -> str:
    """CTEs ``best`` (doc_id, language, score): 3-gram model trained on (lang, text), applied to (doc_id, text)."""

    def grams(source: str, key: str) -> str:
        return (f"SELECT {key}, c[i] || c[i+1] || c[i+2] AS gram FROM (SELECT {key}, c, unnest(range(1, len(c) - 1)) AS i "
                f"FROM (SELECT {key}, string_split(text, '') AS c FROM {source}))")

    return f"""
    profile AS (SELECT lang, gram, count(*) AS n FROM ({grams(trained, 'lang')}) GROUP BY ALL),
    norms AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM profile) AS v FROM profile GROUP BY lang),
    doc_grams AS (SELECT doc_id, gram, count(*) AS c FROM ({grams(scored, 'doc_id')}) GROUP BY ALL),
    doc_totals AS (SELECT doc_id, sum(c) AS c FROM doc_grams GROUP BY doc_id),
    found AS (SELECT doc_id, lang, sum(c * ln(n + 1)) AS w FROM doc_grams JOIN profile USING (gram) GROUP BY ALL),
    rated AS (SELECT t.doc_id, m.lang, round(coalesce(f.w, 0) - t.c * ln(m.total + m.v), 6) AS score
        FROM doc_totals t CROSS JOIN norms m LEFT JOIN found f ON f.doc_id = t.doc_id AND f.lang = m.lang),
    best AS (SELECT doc_id, lang AS language, score FROM rated
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)"""


def hashed_scores(trained: str, scored: str) -> str:
    """CTEs ``best`` (doc_id, language, score): hashed 3-gram model trained on (lang, text), applied to (doc_id, text)."""
    a, b, _ = hl.WEIGHTS

    def grams(source: str, key: str) -> str:
        return (f"SELECT {key}, (c[i] * {a} + c[i + 1] * {b} + c[i + 2]) % {hl.BUCKETS} AS gram FROM (SELECT {key}, c, unnest(range(1, len(c) - 1)) AS i "
                f"FROM (SELECT {key}, list_transform(string_split(text, ''), lambda x: unicode(x)) AS c FROM {source}))")

    return f"""
    profile AS (SELECT lang, gram, count(*) AS n FROM ({grams(trained, 'lang')}) GROUP BY ALL),
    norms AS (SELECT lang, sum(n) AS total FROM profile GROUP BY lang),
    doc_grams AS (SELECT doc_id, gram, count(*) AS c FROM ({grams(scored, 'doc_id')}) GROUP BY ALL),
    doc_totals AS (SELECT doc_id, sum(c) AS c FROM doc_grams GROUP BY doc_id),
    found AS (SELECT doc_id, lang, sum(c * ln(n + 1)) AS w FROM doc_grams JOIN profile USING (gram) GROUP BY ALL),
    rated AS (SELECT t.doc_id, m.lang, round(coalesce(f.w, 0) - t.c * ln(m.total + {hl.BUCKETS}), 6) AS score
        FROM doc_totals t CROSS JOIN norms m LEFT JOIN found f ON f.doc_id = t.doc_id AND f.lang = m.lang),
    best AS (SELECT doc_id, lang AS language, score FROM rated
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)"""


def top_words(source: str, k: int = 60) -> str:
    """CTEs ``kw`` (doc_id, rank, word, weight) from ``source`` (doc_id, ord, text)."""
    return f"""
    word_lists AS (SELECT doc_id, ord, {words('text')} AS ws FROM {source}),
    tokens AS ({numbered('ws', 'word_lists', 'doc_id, ord', 'word', 'pos')}),
    tally AS (SELECT doc_id, word, count(*) AS n, min((ord, pos)) AS first FROM tokens GROUP BY doc_id, word),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank,
                      max(n) OVER (PARTITION BY doc_id) AS top FROM tally),
    kw AS (SELECT doc_id, CAST(rank AS INTEGER) AS rank, word, {four_digits('n', 'top')} AS weight
        FROM placed WHERE rank <= {k})"""


def json_text(value: str) -> str:
    return f"json_quote({value})"

"""Queries over documents: ingest, requests, inference, assembly, reports, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import codes, replies
from ..functions import text as tx
from ..operators import assemble as asm
from ..operators import inference as inf
from ..operators import keywords as kw
from ..operators import memo
from ..operators import pages as pg
from ..operators import progress as pr
from ..operators import requests as rq
from ..operators.packing import chunk_pages as pack
from ..session import scratch_dir, stage
from ..sources import html as web
from ..sources.html import BLOCK_TAGS, DROPPED_ELEMENTS, ENTITY, NAMED, RENUMBERED, html_text
from ..sources.uploads import first_copies, split_pages, validate, with_digest
from . import sql as q
from .registry import query, table
from .text_queries import HAN_SQL, KEPT_SQL, _DETECT_SQL, detected_languages, documents, headed_pages, tfidf_sql

# --- ingest ---------------------------------------------------------------------

_UPLOAD_MAX = 8000
_UPLOAD_SQL = """uploads AS (SELECT doc_id, CASE WHEN source = 'src5' THEN '' ELSE text END AS body,
    doc_id || CASE lang WHEN 'en' THEN '.PDF' WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '.txt' ELSE '' END AS filename FROM documents)"""


def _uploads(spark, sf_dir) -> DataFrame:
    ending = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "fr", ".pdf").when(F.col("lang") == "de", ".txt")
    body = F.when(F.col("source") == "src5", "").otherwise(F.col("text"))
    rows = documents(spark, sf_dir).select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), ending.otherwise("")).alias("filename"),
        F.encode(body, "UTF-8").alias("content"))
    return rows.withColumn("length", F.octet_length("content"))


@query(f"""WITH {_UPLOAD_SQL} SELECT doc_id, filename, CASE WHEN octet_length(encode(body)) = 0 THEN 400
WHEN octet_length(encode(body)) > {_UPLOAD_MAX} THEN 413 WHEN NOT lower(filename) LIKE '%.pdf' THEN 415 END AS reject,
left(sha256(body), 16) AS digest FROM uploads""")
def upload_validation(spark, sf_dir):
    checked = with_digest(validate(_uploads(spark, sf_dir), _UPLOAD_MAX))
    return checked.select("doc_id", "filename", "reject", "digest")


@query(f"""WITH {_UPLOAD_SQL} SELECT left(sha256(body), 16) AS digest, min(doc_id) AS doc_id, count(*) AS n_copies
FROM uploads GROUP BY 1""")
def upload_dedup(spark, sf_dir):
    return first_copies(with_digest(_uploads(spark, sf_dir)), "doc_id")


@query("""SELECT doc_id, left(sha256(left(sha256(text), 16) || '#' || doc_id), 16) AS job_id,
'data:image/png;base64,' || to_base64(encode(text)) AS uri, text AS decoded FROM documents""")
def job_ids(spark, sf_dir):
    docs = documents(spark, sf_dir)
    content = F.encode("text", "UTF-8")
    rows = docs.select("doc_id", codes.job_id(codes.digest(content), F.col("doc_id")).alias("job_id"),
                       codes.image_uri(content).alias("uri"))
    return rows.withColumn("decoded", F.decode(codes.image_bytes(F.col("uri")), "UTF-8"))


@query(f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
n AS ({q.numbered('ps', 'p', 'doc_id', 'page', 'page_no')})
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(page_no AS BIGINT) AS page_no, {q.strip('page')} AS text FROM n""")
def text_pages(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return split_pages(rows)


def _entity_sql(p: str) -> str:
    def looked_up(table: dict, show, key: str) -> str:
        return f"MAP {{{', '.join(f'{show(k)}: {q.text(c)}' for k, c in table.items())}}}[{key}]"

    code = f"""CAST(CASE WHEN {p}[3] IN ('x', 'X') THEN '0x' || {p}[4:-2] ELSE {p}[3:-2] END AS INTEGER)"""
    char = (f"CASE WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN coalesce({looked_up(RENUMBERED, str, code)}, chr({code})) "
            f"ELSE chr(65533) END")
    return f"CASE WHEN {p}[1] <> '&' OR {p} = '&' THEN {p} WHEN {p}[2] = '#' THEN {char} ELSE coalesce({looked_up(NAMED, q.text, p + '[2:-2]')}, {p}) END"


def _html_sql() -> str:
    out = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
    for name in DROPPED_ELEMENTS:
        out = f"regexp_replace({out}, '<{name}\\b.*?</{name}\\s*>', '', 'gis')"
    out = f"regexp_replace({out}, '</?(?:{BLOCK_TAGS})\\b[^>]*>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    out = f"array_to_string(list_transform(regexp_extract_all({out}, {q.text(ENTITY + '|[^&]+|&')}), lambda p: {_entity_sql('p')}), '')"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    return q.strip(f"regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g')")


@query(f"SELECT page_id, url, {_html_sql()} AS text FROM pages")
def html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", html_text(F.col("html")).alias("text"))


@query(f"SELECT CAST(page_id AS VARCHAR) AS doc_id, 0::BIGINT AS page_no, coalesce({_html_sql()}, '') AS text FROM pages")
def html_page_table(spark, sf_dir):
    return web.html_pages(table(spark, sf_dir, "pages"), "page_id", "html")


_OCR_SQL = f"""ocr AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn // 8 AS page_no,
    {q.strip("string_agg(text, chr(10) ORDER BY turn)")} AS ocr_text FROM conversations GROUP BY 1, 2)"""


def _ocr(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.floor(F.col("turn") / 8).alias("page_no"),
        F.col("turn").alias("line_no"), "text")
    return pg.assemble_ocr(lines)


@query(f"WITH {_OCR_SQL} SELECT * FROM ocr")
def ocr_lines(spark, sf_dir):
    return _ocr(spark, sf_dir)


@query(f"""WITH {_OCR_SQL}, p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0::BIGINT AS page_no,
    {q.strip("CASE WHEN lang = 'fr' THEN ' ' || source ELSE text END")} AS text FROM documents)
SELECT doc_id, page_no, CASE WHEN length(text) < 40 AND length(coalesce(ocr_text, '')) > length(text) THEN ocr_text ELSE text END AS text
FROM p LEFT JOIN ocr USING (doc_id, page_no)""")
def ocr_merge(spark, sf_dir):
    scanned = F.when(F.col("lang") == "fr", F.concat(F.lit(" "), "source")).otherwise(F.col("text"))
    pages = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"),
                                            F.lit(0).cast("bigint").alias("page_no"), scanned.alias("text"))
    return pg.merge_ocr(pages, _ocr(spark, sf_dir))


# --- requests and replies ---------------------------------------------------------

_PAGES_SQL = "pages_in AS (SELECT source AS doc_id, doc_id AS page_no, text FROM documents)"


def _chunks(spark, sf_dir) -> DataFrame:
    pages = documents(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text",
                                            F.col("n_chars").alias("size"))
    return pack(pages, fv.CHUNK_CHARS)


def _flat(requests: DataFrame) -> DataFrame:
    return requests.select("doc_id", F.col("index").alias("idx"), "win_idx", "kind",
                           F.col("messages")[0]["content"].alias("system_text"),
                           F.col("messages")[1]["content"].alias("user_text"), "temperature", "max_tokens")


def _flat_sql(source: str, kind: str, system: str, user: str, temperature: float, tokens: str,
              index: str = "idx", win: str = "0") -> str:
    return (f"SELECT doc_id, CAST({index} AS BIGINT) AS idx, CAST({win} AS BIGINT) AS win_idx, '{kind}' AS kind, "
            f"{q.text(system)} AS system_text, {user} AS user_text, CAST({temperature} AS DOUBLE) AS temperature, "
            f"CAST({tokens} AS INTEGER) AS max_tokens FROM {source}")


@query(f"WITH RECURSIVE {_PAGES_SQL}, {q.packed('pages_in')} "
       + _flat_sql("chunks", "summary", fv.SUMMARY_SYSTEM, f"{q.text(fv.SUMMARY_PREFIX)} || original", 0.3, "900"))
def summary_requests(spark, sf_dir):
    return _flat(rq.summary_requests(_chunks(spark, sf_dir)))


_WINDOW_SOURCE = "(SELECT doc_id, text FROM documents)"


def _docs_as_chunks(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.lit(0).alias("index"), F.col("text").alias("original"))


@query(f"WITH RECURSIVE {q.window_walk('documents')} " + _flat_sql(
    "wins", "translation", fv.TRANSLATE_SYSTEM.format(name="正體中文（繁體）"), "win", 0.2,
    "least(2048, length(win) + 500)", index="0", win="win_idx"))
def translation_requests(spark, sf_dir):
    return _flat(rq.translation_requests(_docs_as_chunks(spark, sf_dir)))


@query(f"WITH RECURSIVE {_PAGES_SQL}, {q.packed('pages_in')}, head AS (SELECT doc_id, idx, left(original, 1500) AS h FROM chunks) "
       + _flat_sql("head WHERE idx < 3", "translation", fv.TRANSLATE_SYSTEM.format(name="日本語"), "h", 0.2,
                   "least(2048, length(h) // 2 + 400)"))
def sample_requests(spark, sf_dir):
    return _flat(rq.sample_requests(pg.first_chunks(_chunks(spark, sf_dir), fv.SCRIPT_MAX_CHUNKS), "jpn_Jpan"))


_OVERVIEW_SQL = ("o AS (SELECT conv_id AS doc_id, turn // 1024 AS part, "
                 "string_agg('[段落 ' || (turn + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS joined "
                 "FROM conversations GROUP BY 1, 2)")


@query(f"WITH {_OVERVIEW_SQL} " + _flat_sql(
    "o", "overview", fv.OVERVIEW_SYSTEM,
    f"{q.text(fv.OVERVIEW_PREFIX)} || joined", 0.3, "1400", index="part"))
def global_request(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index"), "text")
    return _flat(rq.overview_requests(turns))


def _repeat_texts(asked: DataFrame) -> DataFrame:
    """A stand-in model for overviews: says again what it was given."""
    said = F.substring(F.col("messages")[1]["content"], len(fv.OVERVIEW_PREFIX) + 1, 2**31 - 1)
    return asked.select("doc_id", "index", said.alias("text"), F.lit(None).cast("string").alias("error"))


def _level_sql(source: str, doc: str, index: str) -> str:
    return (f"SELECT {doc} AS doc_id, {index} // 4 AS idx, string_agg('[段落 ' || ({index} + 1) || ']' || chr(10) || text, chr(10) || chr(10) "
            f"ORDER BY {index}) AS text FROM {source} GROUP BY 1, 2")


# Three levels of four are 64 texts; what needs fewer levels stays as it is.
@query(f"""WITH one AS ({_level_sql('conversations', 'conv_id', 'turn')}),
more AS (SELECT doc_id FROM one WHERE idx > 0),
two AS ({_level_sql('(SELECT * FROM one WHERE doc_id IN (SELECT doc_id FROM more))', 'doc_id', 'idx')}),
most AS (SELECT doc_id FROM two WHERE idx > 0),
three AS ({_level_sql('(SELECT * FROM two WHERE doc_id IN (SELECT doc_id FROM most))', 'doc_id', 'idx')})
SELECT doc_id, text FROM one WHERE doc_id NOT IN (SELECT doc_id FROM more)
UNION ALL SELECT doc_id, text FROM two WHERE doc_id NOT IN (SELECT doc_id FROM most) UNION ALL SELECT doc_id, text FROM three""")
def overview_levels(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index"), "text")
    said, _ = rq.overview_levels(turns, _repeat_texts, per_prompt=4)
    return said.select("doc_id", "text")


_REPLY_SQL = ("'intro' || chr(10) || '## 1. 結論：' || chr(10) || text || chr(10) || '**關鍵數據**' || chr(10) || role "
              "|| chr(10) || '風險 / 限制' || chr(10) || '  ' || chr(10) || '結論' || chr(10) || 'again' || chr(10) || '> 行動建議:' "
              "|| chr(10) || ' ' || text || chr(10) || turn")


@query(f"""SELECT conv_id, turn, {q.strip('text')} AS conclusion, role AS data, '' AS risk,
{q.strip("text || chr(10) || turn")} AS action, {_REPLY_SQL} AS raw FROM conversations""")
def parse_sections(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("intro\n## 1. 結論：\n"), "text", F.lit("\n**關鍵數據**\n"), "role",
                   F.lit("\n風險 / 限制\n  \n結論\nagain\n> 行動建議:\n "), "text", F.lit("\n"), F.col("turn").cast("string"))
    parsed = turns.withColumn("raw_reply", raw).select("conv_id", "turn", replies.parse_overview(F.col("raw_reply")).alias("o"))
    return parsed.select("conv_id", "turn", "o.*")


@query(f"""SELECT doc_id, {q.strip('text')} AS text, CASE WHEN lang = 'fr' THEN 0 ELSE n_chars END AS completion_tokens,
CASE WHEN lang = 'en' THEN round((CASE WHEN lang = 'fr' THEN 0 ELSE n_chars END) / 7.0, 6) ELSE 0.0 END AS tokens_per_sec
FROM documents""")
def completion_parse(spark, sf_dir):
    message = F.struct(F.struct(F.concat(F.lit("<think>hm\n</think> "), "text").alias("content")).alias("message"))
    usage = F.when(F.col("lang") != "fr", F.struct(F.col("n_chars").alias("completion_tokens")))
    body = F.to_json(F.struct(F.array(message).alias("choices"), usage.alias("usage")))
    rows = documents(spark, sf_dir).select("doc_id", "lang", replies.completion(body).alias("r"))
    elapsed = F.when(F.col("lang") == "en", 7.0).otherwise(0.0)
    return rows.select("doc_id", "r.text", "r.completion_tokens",
                       F.round(replies.tokens_per_second(F.col("r.completion_tokens"), elapsed), 6).alias("tokens_per_sec"))


def _echo():
    """A stand-in model: answers with the budget and the text it was given."""
    return lambda system, user, max_tokens, temperature: (f"<think>{system}</think>[{max_tokens}] {user}", len(user))


@query(f"""WITH RECURSIVE {q.window_walk('documents')},
said AS (SELECT doc_id, win_idx, length(win) AS z, {q.strip("'[' || least(2048, length(win) + 500) || '] ' || win")} AS t FROM wins)
SELECT doc_id, string_agg(t, chr(10) ORDER BY win_idx) AS text, CAST(sum(z) AS BIGINT) AS completion_tokens, NULL::VARCHAR AS error
FROM said GROUP BY doc_id""")
def run_inference_stub(spark, sf_dir):
    replied = inf.run_inference(rq.translation_requests(_docs_as_chunks(spark, sf_dir)), _echo)
    return inf.merge_translations(replied).select("doc_id", "text", "completion_tokens", "error")


def _says(word: str):
    return lambda: lambda system, user, max_tokens, temperature: (f"{word} {user}", len(user))


@query(f"""WITH RECURSIVE {q.window_walk('documents')},
old AS (SELECT DISTINCT win FROM wins JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr')),
calls AS (SELECT count(DISTINCT win) AS n FROM wins WHERE win NOT IN (SELECT win FROM old))
SELECT doc_id, win_idx, win IN (SELECT win FROM old) AS known, {q.strip("CASE WHEN win IN (SELECT win FROM old) THEN 'old ' ELSE 'new ' END || win")} AS text,
  length(win) AS completion_tokens, calls.n AS calls FROM wins, calls""")
def reply_memo(spark, sf_dir):
    """Two runs over one reply table: what the first asked is not asked again, nor what several documents ask."""
    store = scratch_dir(spark, "replies")
    asked = rq.translation_requests(_docs_as_chunks(spark, sf_dir))
    first = documents(spark, sf_dir).filter("lang IN ('en', 'fr')").select("doc_id")
    memo.ask_once(asked.join(first, "doc_id", "left_semi"), _says("old"), store)
    told = stage(memo.ask_once(asked, _says("new"), store), "told")
    return told.select("doc_id", "win_idx", F.col("text").startswith("old ").alias("known"), "text", "completion_tokens",
                       F.lit(told.filter("NOT hit").count()).alias("calls"))


@query(f"""WITH s AS (SELECT doc_id, {q.sentence_list('text')} AS ss,
    CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' WHEN 'de' THEN 'deu_Latn' ELSE 'spa_Latn' END AS code FROM documents)
SELECT doc_id, array_to_string(list_transform(ss, lambda x: code || '(' || x || ')'), ' ') AS text, CAST(len(ss) AS BIGINT) AS n_sentences
FROM s WHERE len(ss) > 0""")
def sentence_translation(spark, sf_dir):
    chunks = documents(spark, sf_dir).select("doc_id", "lang", F.lit(0).alias("index"), F.col("text").alias("original"))
    asked = rq.sentence_requests(chunks, codes.source_code(F.col("lang"), fv.SOURCE_LANGUAGE))
    replied = inf.run_batches(asked, lambda: lambda texts, source: [f"{source}({t})" for t in texts])
    merged = inf.merge_translations(replied, " ").select("doc_id", "text")
    counts = inf.with_sentence_count(chunks).select("doc_id", F.col("n_sentences").cast("bigint").alias("n_sentences"))
    return merged.join(counts, "doc_id")


# --- assembly ---------------------------------------------------------------------

_SEGMENT_SQL = f"""seg AS (SELECT doc_id, idx, original,
    CASE WHEN doc_id NOT LIKE '%1' THEN upper(doc_id) || ': ' || original END AS summary,
    CASE WHEN doc_id NOT LIKE '%c1%' THEN replace(original, 'e', '&') END AS translated FROM chunks)"""


def _replies(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries and translations; a few documents have none of a kind."""
    doc = F.col("doc_id")
    summaries = chunks.filter(~doc.endswith("1")).select(
        "doc_id", "index", F.concat(F.upper("doc_id"), F.lit(": "), "original").alias("text"))
    translations = chunks.filter(~doc.contains("c1")).select(
        "doc_id", "index", F.replace("original", F.lit("e"), F.lit("&")).alias("text"))
    return summaries, translations


def _segments(chunks: DataFrame) -> DataFrame:
    return asm.assemble_segments(chunks, *_replies(chunks))


@query(f"""WITH RECURSIVE {_PAGES_SQL}, {q.packed('pages_in')}, {_SEGMENT_SQL}
SELECT doc_id, idx // 1024 AS part, idx, original, translated, summary FROM seg""")
def segments_nested(spark, sf_dir):
    chunks = stage(_chunks(spark, sf_dir), "chunks")
    nested = asm.nest_replies(chunks, *_replies(chunks), 1024)
    flat = nested.select("doc_id", "part", F.inline("segments"))
    return flat.withColumnRenamed("index", "idx")


_RESULT_SQL = f"""{KEPT_SQL}, {q.packed('kept')}, {_DETECT_SQL},
{q.top_words("(SELECT doc_id, page_no AS ord, text FROM kept JOIN detected USING (doc_id) WHERE language <> 'zh')")},
{tfidf_sql(f"SELECT doc_id, list_concat({q.words('x')}, {HAN_SQL}) AS ws FROM (SELECT doc_id, text AS x FROM kept JOIN detected USING (doc_id) WHERE language = 'zh')")},
kws AS (SELECT doc_id, string_agg(word, ',' ORDER BY rank) AS keywords,
    string_agg(word, ',' ORDER BY rank) FILTER (WHERE rank <= 30) AS shown
    FROM (SELECT doc_id, rank, word FROM kw UNION ALL SELECT doc_id, rank, word FROM tfidf) GROUP BY doc_id),
result AS (SELECT p.doc_id, total_pages, n_chunks, chunk_chars, language, coalesce(keywords, '') AS keywords, coalesce(shown, '') AS shown
    FROM (SELECT doc_id, count(*) AS total_pages FROM headed GROUP BY doc_id) p
    JOIN (SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(original)) AS BIGINT) AS chunk_chars FROM chunks GROUP BY doc_id) c USING (doc_id)
    JOIN detected USING (doc_id) LEFT JOIN kws USING (doc_id))"""


def _results(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Results and chunks of the pages grouped by source."""
    raw = headed_pages(spark, sf_dir)
    kept = stage(pg.meaningful_pages(raw), "kept")
    chunks = stage(pack(kept, fv.CHUNK_CHARS), "chunks")
    languages = stage(detected_languages(chunks, documents(spark, sf_dir)), "languages")
    texts = kept.select("doc_id", F.col("page_no").alias("ord"), "text")
    words = kw.keyword_arrays(kw.extract_keywords(texts, languages))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("src"), F.col("conv_id").cast("string")).alias("doc_id"), F.col("turn").alias("index"), "text")
    reply = F.concat(F.lit("結論\n"), "text", F.lit("\n行動\n"), "doc_id")
    overviews = rq.overview_levels(turns, _repeat_texts)[0].select(
        "doc_id", replies.parse_overview(reply).alias("global_summary"))
    results = asm.document_results(pg.page_counts(raw), pg.chunk_counts(chunks), languages, words, overviews)
    return results, chunks


@query(f"""WITH RECURSIVE {_RESULT_SQL}
SELECT doc_id, total_pages, n_chunks, chunk_chars, language, keywords, shown, '/documents/' || doc_id || '/report.pdf' AS report_pdf_url FROM result""")
def document_result(spark, sf_dir):
    results, _ = _results(spark, sf_dir)
    return results.select("doc_id", "total_pages", "n_chunks", "chunk_chars", "language",
                          F.array_join("keywords", ",").alias("keywords"),
                          F.array_join(codes.shown_keywords(F.col("keywords")), ",").alias("shown"), "report_pdf_url")


def _markup_sql(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>')"


def _clipped_sql() -> str:
    from .text_queries import _clip_sql
    return _clip_sql("b")


@query(f"""WITH RECURSIVE {_RESULT_SQL}, {_SEGMENT_SQL},
{_OVERVIEW_SQL}, ov AS (SELECT 'src' || doc_id AS doc_id, {q.strip('joined')} AS conclusion, 'src' || doc_id AS action FROM o WHERE part = 0),
r AS (SELECT result.*, conclusion, action FROM result LEFT JOIN ov USING (doc_id)),
sb AS (SELECT *, {q.strip('original')} AS b, left({q.strip('original')}, 700) AS h FROM seg),
head_rows AS (
    SELECT doc_id, 0 AS ord, 'title' AS kind, '{fv.REPORT_TITLE}' AS text FROM r
    UNION ALL SELECT doc_id, 1, 'meta', '共 ' || total_pages || ' 頁　·　語言：' || language || '　·　有效段落 ' || n_chunks FROM r
    UNION ALL SELECT doc_id, 2, 'heading', '全局重點' FROM r WHERE conclusion <> '' OR action <> ''
    UNION ALL SELECT doc_id, 3, 'tag', '結論' FROM r WHERE conclusion <> ''
    UNION ALL SELECT doc_id, 4, 'body', {_markup_sql('conclusion')} FROM r WHERE conclusion <> ''
    UNION ALL SELECT doc_id, 9, 'tag', '行動建議' FROM r WHERE action <> ''
    UNION ALL SELECT doc_id, 10, 'body', {_markup_sql('action')} FROM r WHERE action <> ''
    UNION ALL SELECT doc_id, 14, 'heading', '逐段對照' FROM r),
seg_rows AS (
    SELECT doc_id, idx, 0 AS ord, 'segment' AS kind, '段落 ' || (idx + 1) AS text FROM sb
    UNION ALL SELECT doc_id, idx, 1, 'tag', '摘要' FROM sb WHERE summary IS NOT NULL
    UNION ALL SELECT doc_id, idx, 2, 'body', {_markup_sql('summary')} FROM sb WHERE summary IS NOT NULL
    UNION ALL SELECT doc_id, idx, 3, 'tag', '譯文' FROM sb WHERE translated IS NOT NULL
    UNION ALL SELECT doc_id, idx, 4, 'body', {_markup_sql('translated')} FROM sb WHERE translated IS NOT NULL
    UNION ALL SELECT doc_id, idx, 5, 'note', '{fv.REPORT_NOTHING}' FROM sb WHERE summary IS NULL AND translated IS NULL
    UNION ALL SELECT doc_id, idx, 6, 'tag', '原文' FROM sb
    UNION ALL SELECT doc_id, idx, 7, 'original', {_markup_sql('(' + _clipped_sql() + ')')} FROM sb)
SELECT doc_id, 0 AS section, -1::BIGINT AS idx, ord, kind, text FROM head_rows
UNION ALL SELECT doc_id, 1, idx, ord, kind, text FROM seg_rows""")
def report_rows(spark, sf_dir):
    results, chunks = _results(spark, sf_dir)
    return asm.report_rows(results, _segments(chunks)).withColumnRenamed("index", "idx")


# --- progress ---------------------------------------------------------------------

_PROGRESS_SQL = f"""{KEPT_SQL}, {q.packed('kept')},
by_source AS (SELECT doc_id, total_pages, coalesce(n_chunks, 0) AS n_chunks FROM
    (SELECT doc_id, count(*) AS total_pages FROM headed GROUP BY doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id) USING (doc_id)),
by_page AS (SELECT 'p' || page_no AS doc_id, 1::BIGINT AS total_pages,
    CASE WHEN meaningful AND clean <> '' THEN 1 ELSE 0 END::BIGINT AS n_chunks FROM classified),
d AS (SELECT *, length(doc_id) % 2 = 0 AS skip, length(doc_id) % 3 <> 0 AS summ, doc_id LIKE '%1%' AS cloud,
    doc_id NOT LIKE '%7%' AS rep, CASE WHEN doc_id LIKE '%9%' THEN 'boom' END AS error, 2 AS after
    FROM (SELECT * FROM by_source UNION ALL SELECT * FROM by_page)),
ev AS (
    SELECT doc_id, 0 AS s, 0::BIGINT AS i, 'progress' AS type, 3 AS progress, '{fv.MSG_EXTRACT}' AS message FROM d
    UNION ALL SELECT doc_id, 1, 0, 'progress', 15, '擷取完成：' || total_pages || ' 頁 → 有效內容 ' || n_chunks || ' 段' FROM d
    UNION ALL SELECT doc_id, 2, 0, 'error', 100, '{fv.MSG_NO_TEXT}' FROM d WHERE n_chunks = 0
    UNION ALL SELECT doc_id, 2, 0, 'progress', 16, '原文已是目標語言（zh），略過翻譯' FROM d WHERE n_chunks > 0 AND skip
    UNION ALL SELECT doc_id, 3, k, 'progress', 15 + floor(75 * (k + 1) / n_chunks)::INTEGER, '完成第 ' || (k + 1) || '/' || n_chunks || ' 段'
        FROM (SELECT doc_id, n_chunks, unnest(range(0, CASE WHEN error IS NULL THEN n_chunks ELSE least(n_chunks, after) END)) AS k FROM d)
    UNION ALL SELECT doc_id, 4, 0, 'progress', 90, '{fv.MSG_OVERVIEW}' FROM d WHERE n_chunks > 0 AND (error IS NULL OR after >= n_chunks) AND summ
    UNION ALL SELECT doc_id, 5, 0, 'progress', 93, '{fv.MSG_KEYWORDS}' FROM d WHERE n_chunks > 0 AND error IS NULL AND cloud
    UNION ALL SELECT doc_id, 6, 0, 'progress', 97, '{fv.MSG_REPORT}' FROM d WHERE n_chunks > 0 AND error IS NULL AND rep
    UNION ALL SELECT doc_id, 7, 0, 'result', 100, '{fv.MSG_DONE}' FROM d WHERE n_chunks > 0 AND error IS NULL
    UNION ALL SELECT doc_id, 8, 0, 'error', 100, '處理失敗：boom' FROM d WHERE n_chunks > 0 AND error IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_PROGRESS_SQL}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, i) - 1 AS seq, type, progress, message FROM ev""")
def progress_events(spark, sf_dir):
    raw = headed_pages(spark, sf_dir)
    marked = pg.classify_pages(raw).select("doc_id", "page_no", "meaningful", "clean", F.length("clean").alias("size"))
    marked = stage(marked, "marked")
    kept = marked.filter("meaningful and clean != ''").select(
        "doc_id", "page_no", F.col("clean").alias("text"), "size")
    counts = pg.chunk_counts(pack(kept, fv.CHUNK_CHARS))
    by_source = pg.page_counts(raw).join(counts, "doc_id", "left").select(
        "doc_id", "total_pages", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    has_text = F.when(F.col("meaningful") & (F.col("clean") != ""), 1).otherwise(0).cast("bigint")
    by_page = marked.select(F.concat(F.lit("p"), F.col("page_no").cast("string")).alias("doc_id"),
                            F.lit(1).cast("bigint").alias("total_pages"), has_text.alias("n_chunks"))
    doc = F.col("doc_id")
    docs = by_source.unionByName(by_page).withColumns({
        "language": F.lit("zh"), "skip_translation": F.length(doc) % 2 == 0, "do_summary": F.length(doc) % 3 != 0,
        "do_wordcloud": doc.contains("1"), "do_report": ~doc.contains("7"),
        "error": F.when(doc.contains("9"), "boom"), "failed_after": F.lit(2),
    })
    return pr.progress_events(docs)

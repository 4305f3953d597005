"""The operators over the given tables, one query each, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, stage
from . import bbit_minhash, bestfit, chat, infill, laesa, line_dedup, mixing, patience, phrase_index, quality_rules, rule_ensemble, shards, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOPS = ", ".join(f"'{x}'" for x in sorted({*quality_rules.STOP_WORDS, *(x.capitalize() for x in quality_rules.STOP_WORDS)}))


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
           FROM documents),
windows AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM d, generate_series(1, len(ws) - 7) AS g(i)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, generate_series(0, 7) AS g(k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], ws), 'string_agg', '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(list_aggregate(list_concat([''], ws), 'string_agg', ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS BIGINT) AS n_stop_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN covered USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.25 AND n_stop_words / n_words >= 0.04
    AND n_dup_lines / n_lines <= 0.5 AS kept,
  n_lines, n_stop_words
FROM v""")
def op10_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


_TERMS_SQL = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


@query(f"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS ws FROM documents),
b AS (SELECT item_id, {_TERMS_SQL} AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + 9), ' ') AS win
       FROM b, generate_series(1, greatest(len(ws) - 9, 1)) AS g(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
       FROM d, lens, generate_series(1, len(ws) - n + 1) AS g(i)),
m AS (SELECT doc_id, i, iw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, generate_series(0, m.n - 1) AS g(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op2_phrase_index(spark, sf_dir):
    found = phrase_index.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS sh
      FROM d, generate_series(1, greatest(len(ws) - 4, 1)) AS g(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op3_bbit_minhash(spark, sf_dir):
    found = bbit_minhash.near_duplicates(read(spark, sf_dir, "documents"), similar=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op5_mix_sources(spark, sf_dir):
    return mixing.taken_words(read(spark, sf_dir, "documents")).drop("text_hash")


@query()
def op8_shard_splitters(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    slim = docs.select("doc_id", shards.row_size().alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                       F.xxhash64("text", F.col("text").isNull()).alias("key"))
    # Only numbers go on, so the texts are read once.
    slim = stage(slim, "shard-keys")
    out = shards.shard(slim, F.col("key"), F.col("doc_id"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, chr(16), chr(16) || '0')"
    for i, control in enumerate(chat.CONTROLS):
        out = f"replace({out}, '{control}', chr(16) || chr({ord('A') + i}))"
    return out


@query(f"""
WITH rows_in AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(replace({_escaped_sql('role')}, chr(10), chr(16) || '1')) + 1 + length({_escaped_sql('text')}) + 11) AS BIGINT) AS formatted_chars
FROM rows_in GROUP BY conv_id""")
def op7_chat_bytes(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS winner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN winner <> page_id THEN winner END AS refers_to, CAST(1 AS BIGINT) AS n_requests, CAST(1 AS BIGINT) AS n_metadata
FROM w""")
def op9_warc_transactions(spark, sf_dir):
    path = scratch_dir(spark, "archives")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path)
    # Lengths and digests are taken from the payloads themselves before the records are joined.
    whole = F.col("type") == "response"
    measured = records.withColumns({"bytes": F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")),
                                    "digest": F.when(whole, F.sha1("payload")).otherwise(F.col("stated_digest"))}).drop("payload")
    captures = warc.assemble_transactions(stage(measured, "records")).filter("capture IS NOT NULL")
    return captures.select(
        "capture.page_id", F.col("capture.bytes").alias("payload_bytes"), F.col("capture.digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"), F.col("capture.refers_to_page").alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"), F.size("metadata").cast("long").alias("n_metadata"))


@query()
def op1_rule_ensemble(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.train(docs, read(spark, sf_dir, "labels"))
    scored = rule_ensemble.score_documents(docs, model)
    return scored.select("doc_id", rule_ensemble.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("""
WITH l AS (SELECT doc_id, i AS line, list_extract(ls, i) AS raw, regexp_extract_all(translate(list_extract(ls, i), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x20\\x09-\\x0D]+') AS ws
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), generate_series(1, len(ls)) AS g(i)),
lw AS (SELECT * FROM l WHERE len(ws) > 0),
c AS (SELECT ws, len(ws) AS n, min(CAST(doc_id AS HUGEINT) * 1000000000 + line) AS place FROM lw GROUP BY ws),
v AS (SELECT place, i, list_concat(list_slice(ws, 1, i - 1), list_slice(ws, i + 1, n)) AS rest FROM c, generate_series(1, c.n) AS g(i) WHERE n >= 5),
near AS (SELECT a.place FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i WHERE b.place < a.place
   UNION SELECT a.place FROM v a JOIN c b ON a.rest = b.ws WHERE b.n >= 5 AND b.place < a.place
   UNION SELECT a.place FROM c a JOIN v b ON b.rest = a.ws WHERE a.n >= 5 AND b.place < a.place),
f AS (SELECT CAST(c.place // 1000000000 AS BIGINT) AS doc_id, count(*) AS n_first, count(near.place) AS n_near
      FROM c LEFT JOIN near ON near.place = c.place GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_lines FROM lw GROUP BY doc_id),
gone AS (SELECT place FROM near UNION SELECT CAST(lw.doc_id AS HUGEINT) * 1000000000 + line FROM lw
         WHERE CAST(lw.doc_id AS HUGEINT) * 1000000000 + line NOT IN (SELECT place FROM c)),
t AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line) AS rest FROM l LEFT JOIN gone ON place = CAST(doc_id AS HUGEINT) * 1000000000 + line
      WHERE place IS NULL GROUP BY doc_id),
x AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END AS rest FROM documents LEFT JOIN t USING (doc_id))
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_lines, 0) - coalesce(n_first, 0) AS BIGINT) AS n_exact,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(n_first, 0) - coalesce(n_near, 0) AS BIGINT) AS n_kept,
  CAST(length(rest) AS BIGINT) AS n_chars, sha256(rest) AS text_sha256
FROM documents d JOIN x USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id""")
def op6_line_dedup(spark, sf_dir):
    rest = F.col("text")
    return line_dedup.line_report(read(spark, sf_dir, "documents")).withColumns(
        {"n_chars": F.length(rest).cast("long"), "text_sha256": F.sha2(rest.cast("binary"), 256)}).drop("text")


@query()
def op4_license_patience(spark, sf_dir):
    found = patience.scan_licenses(read(spark, sf_dir, "documents"))
    best = F.get("licenses", F.lit(0))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), best["license"].alias("license"),
                        best["coverage"].alias("coverage"), best["first_word"].alias("first_word"), best["last_word"].alias("last_word"), "licenses")


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
             regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS ts FROM documents),
g AS (SELECT *, len(ts) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(list_slice(ts, 1, lo), '') AS prefix, array_to_string(list_slice(ts, lo + 1, hi), '') AS middle,
        array_to_string(list_slice(ts, hi + 1, n), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""")
def op11_infill(spark, sf_dir):
    out = infill.infill(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("text"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("text").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def _rounds_sql() -> str:
    """One pair of tables per round: nearest centroid of every vector, then the floors of the means."""
    steps = []
    for i in range(laesa.ROUNDS + 1):
        steps.append(f"""
a{i} AS (SELECT row, c AS cluster, d FROM (SELECT x.row, c.c, sum((x.q - c.q) * (x.q - c.q)) AS d FROM x JOIN c{i} c ON x.k = c.k GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)""")
        if i < laesa.ROUNDS:
            steps.append(f"""
s{i} AS (SELECT cluster, k, CAST(sum(q) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{i} USING (row) GROUP BY ALL),
c{i + 1} AS (SELECT c.c, c.k, coalesce((s - ((s % n) + n) % n) // n, c.q) AS q FROM c{i} c LEFT JOIN s{i} s ON s.cluster = c.c AND s.k = c.k)""")
    return ",".join(steps)


@query(f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda e: CAST(floor({laesa.SCALE} * CAST(e AS DOUBLE)) AS HUGEINT)) AS qs
           FROM embeddings WHERE len(embedding) = {laesa.DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {laesa.DIMENSIONS}),
x AS MATERIALIZED (SELECT row, unnest(range({laesa.DIMENSIONS})) AS k, unnest(qs) AS q FROM v),
first AS (SELECT row, row_number() OVER (ORDER BY sha256('{laesa.SEED}:' || vec_id), qs) - 1 AS c FROM v QUALIFY c < {laesa.CLUSTERS}),
c0 AS (SELECT c, k, q FROM x JOIN first USING (row)),{_rounds_sql()},
digests AS (SELECT c, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY k)) AS digest FROM c{laesa.ROUNDS} GROUP BY c)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a{laesa.ROUNDS} JOIN v USING (row) JOIN digests ON digests.c = cluster""")
def op12_laesa_clusters(spark, sf_dir):
    found, _ = laesa.clusters(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query()
def op13_bestfit_packing(spark, sf_dir):
    pieces = bestfit.stored(read(spark, sf_dir, "documents"))
    return bestfit.packed(pieces)

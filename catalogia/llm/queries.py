"""The numbered queries: each applies its operator, with its production parameters, to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogia.llm import ann, bpe, chat, langid, lexical, packing, runs, simhash, telephony, token_files, toxicity, warc, wrappers
from catalogia.llm.common import table

BYTE_BPE, BYTE_BPE_IDS = "byte_bpe_50k.json", 50_257
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), BYTE_BPE_IDS)


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.stored_and_described(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked_fingerprints(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_BPE), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_conversations(table(spark, sf_dir, "conversations"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def with_planted_loops(docs: DataFrame) -> DataFrame:
    """documents with the words from a place on replaced by repeats of the first few of them, in texts that a hash of the id chooses."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select("doc_id", "text", ((h - h % 10) / 10).cast("long").alias("g"), F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("w"))
    n = F.size("w").cast("long")
    placed = chosen.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    left = F.col("n") - F.col("a")
    repeats = F.flatten(F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil(left / F.col("p")).cast("int")))
    looped = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(repeats, F.lit(1), left.cast("int")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_loops(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.select("doc_id", "runs", "collapsed", best.alias("b")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.start")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_files, op3_telephony, op4_nearest_neighbours, op5_simhash, op6_language_id, op7_byte_bpe, op8_warc, op9_tool_calls, op10_best_fit_packing, op11_lexical_search, op12_html_extraction, op13_periodic_runs)}

ORACLE_SQL: dict[str, str] = {
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(d, (1 + 10 * (i // 8))::INT, 10))::BIGINT) >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM f""",
    "op9_tool_calls": """
WITH RECURSIVE src AS (SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id FROM conversations),
calls AS (SELECT id AS call_id, conv_id, turn, text, CASE WHEN role = 'system' THEN 'configure' ELSE 'respond' END AS name,
    CASE WHEN turn = 1 THEN conv_id || ':0' WHEN turn > 1 THEN conv_id || ':' || (turn - 2) END AS parent_id
  FROM src WHERE role IS DISTINCT FROM 'assistant'),
results AS (SELECT conv_id || ':' || (turn - 1) AS rid, id AS result_id, text AS content FROM src WHERE role = 'assistant'),
place AS (SELECT call_id, 0::BIGINT AS depth FROM calls WHERE parent_id IS NULL OR parent_id NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT c.call_id, p.depth + 1 FROM calls c JOIN place p ON c.parent_id = p.call_id),
said AS (SELECT call_id, array_to_string(list_filter([
    CASE WHEN text IS NULL THEN 'missing:prompt' WHEN length(text) < 1 OR (name = 'configure' AND length(text) > 2000) THEN 'range:prompt' END,
    CASE WHEN turn < 0 OR (name = 'configure' AND turn > 0) THEN 'range:turn' END], lambda x: x IS NOT NULL), ',') AS errors FROM calls)
SELECT CASE WHEN c.call_id IS NULL THEN 'orphan_result' ELSE 'call' END AS kind, c.conv_id, coalesce(c.call_id, r.rid) AS call_id, p.depth, c.name,
  CASE WHEN c.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_calls, CASE WHEN r.rid IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results, r.result_id,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.rid IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN c.call_id IS NOT NULL THEN s.errors = '' END AS valid, s.errors,
  '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '{"prompt":' || coalesce(to_json(c.text)::VARCHAR, 'null') || ',"turn":' || c.turn || '}' END
    || ',"id":' || to_json(coalesce(c.call_id, r.rid))::VARCHAR || ',"name":' || coalesce(to_json(c.name)::VARCHAR, 'null')
    || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS message
FROM calls c FULL OUTER JOIN results r ON c.call_id = r.rid LEFT JOIN place p ON p.call_id = c.call_id LEFT JOIN said s ON s.call_id = c.call_id""",
    "op11_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
f AS (SELECT doc_id, t, 25 + (75 * n * n_docs) // n_terms AS m, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d), s WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t, n, n_docs, n_terms),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), s),
r AS (SELECT item_id, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN f USING (t) JOIN w USING (t) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    # The given pages mark their article; SQL takes it there, while the operator finds it by its hosts' wrappers.
    "op12_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS l FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t""",
}

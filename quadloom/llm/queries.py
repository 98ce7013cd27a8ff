"""The operators' queries over the test tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embedding, minhash, packing, pitman_yor, quality, sharding, substring, warc
from .common import table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.verdicts(quality.book(docs, quality.toxic_words(docs, table(spark, sf_dir, "labels"))))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy does, from the stored ledger."""
    docs = table(spark, sf_dir, "documents")
    return quality.ablations(quality.book(docs, quality.toxic_words(docs, table(spark, sf_dir, "labels"))))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) AS x
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
t3 AS (
  SELECT doc_id, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS k
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r3 AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM t3 WHERE k IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p + i) AS n_repeat_words FROM r3, range(0, 3) AS s(i) WHERE n > 1 GROUP BY doc_id),
a AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d),
lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id ORDER BY doc_id LIMIT LABELLED),
lt AS (SELECT toxic, list_distinct(regexp_extract_all(low, '[a-z\x{80}-\x{10FFFF}]+')) AS ws FROM a JOIN lab USING (doc_id)),
lw AS (SELECT word, count(*) FILTER (WHERE toxic = 1) AS t, count(*) FILTER (WHERE toxic <> 1) AS c FROM (SELECT toxic, unnest(ws) AS word FROM lt) AS z GROUP BY word),
lex AS (
  SELECT word FROM lw, (SELECT count(*) FILTER (WHERE toxic = 1) AS nt, count(*) FILTER (WHERE toxic <> 1) AS nc FROM lt) AS n
  WHERE t >= LEAST_N AND t * nc >= c * RATIO_N * nt),
bad AS (
  SELECT doc_id, count(*) AS n_toxic
  FROM (SELECT doc_id, unnest(regexp_extract_all(low, '[a-z\x{80}-\x{10FFFF}]+')) AS x FROM a) AS y
  WHERE x IN (SELECT word FROM lex) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_toxic, 0)::BIGINT AS n_toxic
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN bad USING (doc_id)),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
    + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT + 16 * (10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 2)::BIGINT
    + 32 * (n_toxic >= 2 AND 100 * n_toxic >= n_words)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept,
  failed_bits, n_lines, n_toxic FROM b
"""
for _name, _value in (("LABELLED", quality.LABELLED), ("LEAST_N", quality.LEAST), ("RATIO_N", quality.RATIO)):
    OP3_SQL = OP3_SQL.replace(_name, str(_value))
ABLATIONS_SQL = f"""
WITH v AS ({OP3_SQL}), r AS (SELECT unnest({list(quality.BITS)}) AS rule, unnest({list(quality.BITS.values())}) AS bit)
SELECT rule, count(*) FILTER (WHERE failed_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (WHERE failed_bits = bit)::BIGINT AS n_alone,
  count(*) FILTER (WHERE failed_bits & ~bit = 0)::BIGINT AS n_kept_without
FROM v, r GROUP BY rule
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return chat.digests(rows.unionByName(extra))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b') AS esc,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + CASE WHEN before = role THEN 3 ELSE length(replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'), ']', '\r')) + 9 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.digests(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT a AS node, a AS hop FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.hop = p.a),
c AS (SELECT node, min(hop) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_rules": op3_quality_rules,
    "quality_ablations": quality_ablations,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_sharding": op5_sharding,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_pitman_yor_scoring": op10_pitman_yor_scoring,
}
ORACLES = {
    "op2_chat_formatting": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "quality_ablations": ABLATIONS_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
}

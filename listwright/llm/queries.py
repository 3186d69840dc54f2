"""The operators as queries over their whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listwright.llm import (
    chat,
    decontaminate,
    filter_audit,
    jaccard,
    line_dedup,
    packing,
    periodic_runs,
    pii,
    quality,
    sharding,
    simhash_bk,
    toxicity,
    warc,
)
from listwright.llm.common import table

# The conversation whose texts are control strings themselves.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_conversations(conversations.unionByName(probe)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.document_components(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_components(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
kept AS (SELECT *, strlen(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS largest FROM p)
SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM kept
"""

OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, e.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = reach.seen
)
SELECT reach.doc_id, coalesce(max(n), 0) AS n_shingles, min(seen) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), holders AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.*, coalesce(k.doc_id <> h.first_doc, false) AS gone FROM keyed k LEFT JOIN holders h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY part, mask
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, s.step, h.bit AS here,
         (SELECT coalesce(sum(bit), 0) FROM letters WHERE instr(filter_order, letter) < s.step)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step) s, letters h WHERE h.letter = filter_order[s.step]
)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (mask & (here + before) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & here <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & here <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = here), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(n_good) FILTER (mask & here <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(n_toxic) FILTER (mask & here <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // nullif(bit_count(mask), 0))) FILTER (mask & here <> 0), 0) AS BIGINT) AS shapley
FROM c, steps GROUP BY part, filter_order, step
"""

#: name: (query, SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_chat_formatting": (op2_chat_formatting, OP2_SQL),
    "op3_quality_rules": (op3_quality_rules, None),
    "op4_warc": (op4_warc, OP4_SQL),
    "op5_pii": (op5_pii, None),
    "op6_ngram_jaccard_join": (op6_ngram_jaccard_join, OP6_SQL),
    "op7_sharding": (op7_sharding, None),
    "op8_packing": (op8_packing, None),
    "op9_benchmark_decontamination": (op9_benchmark_decontamination, None),
    "op10_line_dedup": (op10_line_dedup, OP10_SQL),
    "op11_filter_audit": (op11_filter_audit, OP11_SQL),
    "op12_simhash_near_dedup": (op12_simhash_near_dedup, None),
    "op13_periodic_runs": (op13_periodic_runs, None),
    "pipeline": (pipeline, None),
}

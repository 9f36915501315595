"""The queries of this subpackage, with production parameters over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hmm, language, near_dup, quality, secrets, segment, sharding, token_shards
from .scratch import new_path, small_batches

WORD_MODEL, PIECE_MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(n: int):
    """crc32 of the doc_id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), 2)
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask(quality.POLICIES[1])).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "fail_bits", "policy_version")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base, manifest = token_shards.write_shards(docs, WORD_MODEL, end_id=2)
    return token_shards.read_keys(docs, base, manifest)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language.fit(docs, id_remainder(5) != 0)
    rows = docs.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "text")
    return language.predict(rows, filters).drop("text", "coverage", "margin")


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "ordinal", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op6_gumbel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sample_segmentations(table(spark, sf_dir, "documents"), PIECE_MODEL).drop("ids")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turn = F.col("id")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), id_remainder(7) != 2).drop("row")


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, maps = table(spark, sf_dir, "documents"), new_path(spark, "slot-maps")
    sharding.save_map(spark, sharding.first_map(8), maps)
    sharding.save_map(spark, sharding.grown(sharding.load_map(spark, maps, 1)), maps)
    sizes = sharding.slot_bytes(sharding.sized_rows(docs))
    held = {r.vslot: r.bytes for r in sizes.collect()}  # SLOTS rows at most
    sharding.save_map(spark, sharding.rebalanced(sharding.load_map(spark, maps, 2), held), maps)
    rows = sharding.shard_rows(docs, {name: sharding.load_map(spark, maps, k) for k, name in ((1, "shard"), (2, "grown_shard"), (3, "balanced_shard"))}, sizes)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "vslot", "vslot_bytes", "balanced_shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_ledger, op2_token_shards, op3_language, op4_spaced_seeds, op5_secret_scan, op6_gumbel_segments, op7_chat_windows, op8_probminhash, op9_hidden_markov, op10_virtual_slots)}


OP1_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t)),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
g AS (SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g2, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN d USING (r)),
b AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)
  + (CASE WHEN n_words > 1000000 THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  (fail_bits & 31) = 0 AS kept, n_lines, fail_bits, CAST(2 AS BIGINT) AS policy_version FROM b
"""


OP7_SQL = r"""
WITH RECURSIVE t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, 4 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
  12 + length(url_encode(role)) + 1 + length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|</?SYS>>|/?INST\])')) + 11 AS shown FROM t0),
p AS (SELECT *, sum(tokens) OVER w - tokens AS before, first_value(role) OVER w = 'system' AS sys, CASE WHEN first_value(role) OVER w = 'system' THEN first_value(tokens) OVER w ELSE 0 END AS st
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
f AS (SELECT conv_id, k, before AS base, 0 AS span FROM p WHERE k = 1
  UNION ALL SELECT p.conv_id, p.k, CASE WHEN p.before > f.base AND p.before + p.tokens - f.base > greatest(384 - p.st, 1) THEN p.before ELSE f.base END,
    CASE WHEN p.before > f.base AND p.before + p.tokens - f.base > greatest(384 - p.st, 1) THEN f.span + 1 ELSE f.span END FROM f JOIN p ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.k = f.k + 1),
s AS (SELECT conv_id, span, min(k) AS lo, min(base) AS base FROM f GROUP BY conv_id, span),
again AS (SELECT s.conv_id, sum(p.shown) AS n FROM s JOIN p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.k < s.lo AND ((p.k = 1 AND p.sys) OR s.base - p.before <= 128) GROUP BY s.conv_id),
w AS (SELECT conv_id, count(*) AS n_windows FROM s GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss, sum(shown) AS own FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(own + coalesce(again.n, 0) AS BIGINT) AS formatted_chars, n_windows
FROM d JOIN w ON d.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN again ON again.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_ledger": OP1_SQL, "op7_chat_windows": OP7_SQL}

"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from basketlens.llm import (chat_format, cross_polytope, hard_negatives, html_extract, lang_id, mixing, packing, prefix_trie, quality_classifier, quality_rules,
                            simhash, suffix_dedup, topk)
from basketlens.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_texts(docs, length=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_format.digests(chat_format.format_conversations(conversations))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.filter(~lang_id.held_out()))
    return lang_id.predict(docs, model).select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90, scale=256)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.positions(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns, group=100, most=6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_packing": op9_packing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_prefix_trie": op13_prefix_trie,
}

#: SQL cannot express minimum cuts (op1), anchors and merges over whole texts at bearable cost (op3), robust
#: estimates (op4), trained models (op6, op7), a tokenizer (op9), XXH64 (op10) or an approximate search (op12): those are tested
#: against brute force.
ORACLES: dict[str, str] = {
    "op2_mix_sources": r"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, source_size * CAST(2 AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total FROM sizes),
weighed AS (SELECT *, CAST([3, 1, 2][CAST((k - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER up, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS u FROM weighed
  WINDOW up AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sources AS MATERIALIZED (
  SELECT source, source_size, k, greatest(1, CAST(ceil(sqrt(source_size) / 32) AS BIGINT)) AS shards,
         least(cap, coalesce((SELECT u FROM levels WHERE u * w <= cap ORDER BY cap / w, k LIMIT 1) * w, cap)) AS target FROM levels),
placed AS MATERIALIZED (
  SELECT d.*, s.source_size, s.target, s.k, CAST('0x' || substr(md5(concat_ws('/', '42', CAST(d.doc_id AS VARCHAR))), 1, 12) AS BIGINT) % s.shards AS shard
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
shards AS MATERIALIZED (
  SELECT source, k, shard, CAST(sum(size) AS BIGINT) AS shard_size, CAST(ceil(sum(size) / 64) AS BIGINT) AS blocks,
         max(source_size) AS source_size, max(target) AS target FROM placed GROUP BY source, k, shard),
votes AS MATERIALIZED (
  SELECT k, CASE WHEN max(source_size) > 0 THEN max(target) * CAST(sum(blocks) AS DOUBLE) / max(source_size) ELSE 0 END AS votes FROM shards GROUP BY k),
source_quotients AS (SELECT k, votes / (2 * unnest(range(CAST(ceil(votes) AS BIGINT) + 50)) + 1) AS q FROM votes WHERE votes > 0),
source_seats AS MATERIALIZED (
  SELECT k, count(*) AS seats FROM (SELECT k, row_number() OVER (ORDER BY q DESC, k) AS place FROM source_quotients)
  WHERE place <= (SELECT round(sum(votes)) FROM votes) GROUP BY k),
shard_quotients AS (
  SELECT s.k, s.shard, t.seats, s.blocks / (2 * unnest(range(2 * s.blocks + 2)) + 1) AS q
  FROM shards s JOIN source_seats t ON s.k = t.k WHERE s.blocks > 0),
quotas AS MATERIALIZED (
  SELECT k, shard, count(*) AS given FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q DESC, shard) AS place FROM shard_quotients)
  WHERE place <= seats GROUP BY k, shard),
all_blocks AS (
  SELECT s.source, s.k, s.shard, s.blocks, q.given, unnest(range(s.blocks)) AS block FROM shards s JOIN quotas q ON s.k = q.k AND s.shard = q.shard),
taken AS MATERIALIZED (
  SELECT k, shard, block, least(2, given // blocks + CASE WHEN row_number() OVER (
           PARTITION BY k, shard ORDER BY md5(concat_ws('/', '42', source, CAST(shard AS VARCHAR), CAST(block AS VARCHAR))), block) <= given % blocks
         THEN 1 ELSE 0 END) AS copies FROM all_blocks),
laid AS (
  SELECT p.*, s.shard_size, s.blocks, CAST(sum(p.size) OVER (
           PARTITION BY p.k, p.shard ORDER BY md5(concat_ws('/', '43', CAST(p.doc_id AS VARCHAR))), p.doc_id, p.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop, row_number() OVER () AS place
  FROM placed p JOIN shards s ON p.k = s.k AND p.shard = s.shard),
parts AS (
  SELECT *, stop - size AS start, unnest(range((stop - size) * blocks // shard_size, (stop - 1) * blocks // shard_size + 1)) AS block
  FROM laid WHERE size > 0),
cut AS (
  SELECT p.place, sum((least(stop, ((p.block + 1) * shard_size + blocks - 1) // blocks)
                       - greatest(start, (p.block * shard_size + blocks - 1) // blocks)) * copies) AS taken
  FROM parts p JOIN taken t ON p.k = t.k AND p.shard = t.shard AND p.block = t.block GROUP BY p.place)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM laid LEFT JOIN cut USING (place)""",
    "op5_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length('<|turn|>') + length(role) + len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) + len(regexp_extract_all(role, '\n')) + 1
          + length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) + length('<|end|>') + 1 AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op8_exact_top_k": """
WITH good AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op11_hard_negatives": """
WITH good AS (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS MATERIALIZED (
  SELECT a.place AS anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM good a JOIN good c ON a.place <> c.place AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, k
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.same
   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10""",
    "op13_prefix_trie": """
WITH turns AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (
  SELECT conv_id, CAST(xor(list_reduce([4294967295] || flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a // 2, 3988292384 * (a % 2)) END), 4294967295) AS BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS MATERIALIZED (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS digest, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth
  FROM (SELECT c.conv_id, t.role, t.text, t.pos, 0 AS own FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos < c.h
        UNION ALL SELECT c.conv_id, t.role, t.text, t.pos, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h)),
sizes AS (SELECT c.conv_id, count(r.conv_id) AS n FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
steps AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM convs
  UNION ALL SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING), chars FROM rebuilt),
nodes AS MATERIALIZED (
  SELECT s.depth, s.path, min(s.conv_id) AS conv_id, count(*) AS n_convs, max(s.chars) AS chars,
         sha256(coalesce(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (WHERE z.n = s.depth), '')) AS ends_sha256
  FROM steps s JOIN sizes z ON s.conv_id = z.conv_id GROUP BY s.depth, s.path),
linked AS MATERIALIZED (
  SELECT a.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = a.depth + 1 AND left(c.path, 32 * a.depth) = a.path) AS n_children
  FROM nodes a LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.path = left(a.path, 32 * (a.depth - 1)))
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, a.n_children,
       CAST(count(*) FILTER (WHERE d.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((d.n_convs - 1) * d.chars) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM linked a JOIN linked d ON d.depth >= a.depth AND left(d.path, 32 * a.depth) = a.path
GROUP BY a.conv_id, a.depth, a.path, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256""",
}

"""The ten operators as queries over the supplied tables, with production parameters, and their SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import embed_dedup, line_dedup, mixing, packing, pii, quality, sharding, simhash, token_counts, token_files

SHARDS = 24
SHARES = {"clean": 0.85, "junk": 0.10, "toxic": 0.05}
#: The key of the query over the supplied tables, which are invented; for real ones pass pii.key_of(spark).
PUBLIC_KEY = "the supplied tables hold nothing private"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.Tree.build(SHARDS)
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"), tree, tree.expanded())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), PUBLIC_KEY)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), SHARES, vocabulary("word_bpe_49k.json")).drop("text_hash")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents")).drop("host", "text_hash")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_links(_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_pii, op4_mixing, op5_token_files, op6_quality_rules, op7_token_counts, op8_embedding_dedup, op9_packing, op10_simhash)
}

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, chr(0) || 'null') AS site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents WHERE text IS NOT NULL
), keyed AS (SELECT *, trim(raw) AS line FROM lines),
shared AS (
  SELECT line, min((doc_id, place)) AS first FROM keyed WHERE length(line) >= {line_dedup.MIN_CHARS}
  GROUP BY line HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}
), marked AS (
  SELECT k.*, s.line IS NOT NULL AND (k.doc_id, k.place) <> s.first AS gone FROM keyed k LEFT JOIN shared s ON k.line = s.line
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, r.text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""


def quality_sql(limit: float = quality.HOST_LIMIT) -> str:
    rules = ("short", "repetitive", "symbols", "line_copies")
    moments = ", ".join(f"sum({r}) / sum(n) AS m_{r}, var_pop({r} / n) AS v_{r}" for r in rules)
    strength = lambda r: f"CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0), 1e6) ELSE 1e6 END"
    kept = " AND ".join(f"({r} + m_{r} * {strength(r)}) / (n + {strength(r)}) <= {limit}" for r in rules)
    return f"""
WITH parts AS (
  SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM parts WHERE len(words) >= 8)
), twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(next, i + 8) - i)) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id
), stats AS (
  SELECT p.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id
), rules AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repetitive, 10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > 3 * n_lines AS line_copies FROM stats
), hosts AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"sum({r}::INT)::DOUBLE AS {r}" for r in rules)} FROM rules GROUP BY source),
moments AS (SELECT {moments} FROM hosts),
verdicts AS (SELECT source, {kept} AS host_kept FROM hosts, moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, NOT (short OR repetitive) AND host_kept AS kept
FROM rules r JOIN verdicts v ON r.source IS NOT DISTINCT FROM v.source
"""


#: All pairs under a label, and components as what is reachable. Right for any size, and quick for small tables.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.c = l.a),
least AS (SELECT n, min(c) AS component_id FROM reach GROUP BY n), counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT n AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, n = component_id AS kept FROM least LEFT JOIN counts ON n = a
"""


ORACLE_SQL: dict[str, str] = {"op1_line_dedup": LINE_DEDUP_SQL, "op6_quality_rules": quality_sql(), "op8_embedding_dedup": EMBEDDING_SQL}

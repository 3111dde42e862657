"""One query per operator, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing, near_dup, packing, quality_rules, site_quality, token_counts, topk, toxicity, warc
from .text import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return quality_rules.assess(table(spark, sf_dir, "documents")).select(*columns)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    return warc.round_trip(table(spark, sf_dir, "pages")).select(*columns)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no address: the source stands for the host, the language in it for the path."""
    docs = table(spark, sf_dir, "documents")
    return site_quality.score(docs, table(spark, sf_dir, "labels"), docs["source"], docs["lang"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_quality_rules, op3_packing, op4_mixing, op5_topk, op6_near_dup, op7_warc, op8_token_counts, op9_line_dedup, op10_site_quality)
}

SQL: dict[str, str] = {
    # Slots are points of the golden ratio; a source's slots take the stream of its shuffled documents from the start on.
    "op4_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), weighted AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * sum(size) AS cap,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sizes GROUP BY source
), levels AS (
  SELECT source, source_size, weight, cap, cap / weight AS full_at,
         (sum(source_size) OVER () * 3 / 2.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(coalesce(max(level) FILTER (level <= full_at) OVER () * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM levels
), shares AS (
  SELECT source, round(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * 4294967296) AS hi FROM targets WHERE target > 0
), ends AS (
  SELECT source, CAST(hi AS BIGINT) AS hi, CAST(lag(hi, 1, 0) OVER (ORDER BY hi) AS BIGINT) AS lo FROM shares
), points AS (
  SELECT i AS slot, (i % 65536 * 2654435769 + i // 65536 % 65536 * (2654435769 * 65536 % 4294967296)) % 4294967296 AS point
  FROM (SELECT unnest(range(CAST(ceil(sum(target) / 64) AS BIGINT))) AS i FROM targets)
), slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN ends ON point >= lo AND point < hi
), many AS (
  SELECT source, count(*) AS n FROM slots GROUP BY source
), placed AS (
  SELECT doc_id, size, source,
         CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sizes
), cut AS (
  SELECT p.*, t.source_size, t.target, 64 * coalesce(m.n, 0) AS till, least(start + size, till) AS hi, least(start + source_size + size, till) AS hi2, start + source_size AS lo2
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN many m ON p.source IS NOT DISTINCT FROM m.source
)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(greatest(0, hi - start) + greatest(0, hi2 - lo2) AS BIGINT) AS taken,
       CASE WHEN hi > start THEN s.slot END AS first_slot,
       CAST(CASE WHEN hi > start THEN (hi - 1) // 64 - start // 64 + 1 ELSE 0 END + CASE WHEN hi2 > lo2 THEN (hi2 - 1) // 64 - lo2 // 64 + 1 ELSE 0 END AS BIGINT) AS slots
FROM cut c LEFT JOIN slots s ON c.source IS NOT DISTINCT FROM s.source AND s.rank = c.start // 64
""",
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, TRUE AS intact
FROM f
""",
    "op9_line_dedup": r"""
WITH d AS (
  SELECT DISTINCT doc_id, text FROM documents
), l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, text, i, lead(i, 2) OVER o AS last, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id, text ORDER BY i)
), later AS (
  SELECT doc_id, text, i, last FROM w WHERE last IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, i) > 1
), covered AS (
  SELECT DISTINCT doc_id, text, unnest(range(i, last + 1)) AS i FROM later
), kept AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(c.i) AS n_removed, coalesce(string_agg(CASE WHEN c.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS cut
  FROM l LEFT JOIN covered c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.text = c.text AND l.i = c.i GROUP BY ALL
)
SELECT o.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed_lines, md5(k.cut) AS text_md5
FROM documents o LEFT JOIN kept k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text = k.text
""",
}

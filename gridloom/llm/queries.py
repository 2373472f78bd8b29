"""The operators' queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import alignment, bpe, dedup, hard_negatives, lm, mixing, pii, quality, secrets, sharding, token_counts, vector_dedup, warc
from gridloom.llm.common import checkpoint, read


def rank_file() -> tuple[bytes, str]:
    """The production tokenizer's rank file and pattern."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), *rank_file(), with_ids=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), model)


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read(spark, sf_dir, "documents"))


def pii_key(spark: SparkSession) -> str:
    """The secret key that a deployment sets as ``gridloom.pii.key`` of its session; without it, one that is public and for tests only."""
    return spark.conf.get("gridloom.pii.key", "public-test-key")


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), pii_key(spark))


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = checkpoint(warc.write_archives(read(spark, sf_dir, "pages")))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return secrets.scan(documents, secrets.train(secrets.template_findings(spark), secrets.learn_lexicon(documents)))


def alignment_files() -> tuple[bytes, bytes]:
    """The two tokenizers' files: a byte-level JSON file and a piece model."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(read(spark, sf_dir, "documents"), *alignment_files())


def op12_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.place_rows(narrow).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.quantised(e.withColumn("label", moved)), "id % 100 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_deleted_interpolation, op2_quality_rules, op3_embedding_near_dedup, op4_bpe_roundtrip, op5_token_counts, op6_curriculum_mix, op7_minhash_near_dedup, op8_pii_pseudonyms, op9_warc_roundtrip, op10_secret_scan, op11_token_alignment, op12_uniform_shards, op13_hard_negatives)
}

ORACLES: dict[str, str] = {
    "op3_embedding_near_dedup": """
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, v, sqrt(list_dot_product(v, v)) n FROM e WHERE v IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT a, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, least(min(a), min(c)) c FROM r GROUP BY a),
k AS (SELECT a, count(*) n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) n_links, coalesce(m.c, e.vec_id) component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN m ON m.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
""",
    "op7_minhash_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) c FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, coalesce(m.c, w.doc_id) component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN m ON m.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
""",
    "op6_curriculum_mix": """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) size,
  md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size,
  CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER) AS c FROM d GROUP BY source),
w AS (SELECT *, CAST(c + 1 AS DOUBLE) w, CAST(3 * source_size AS DOUBLE) cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, row_number() OVER b AS k FROM w
  WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT min(k) k, arg_min(level, k) AS level FROM l WHERE cap > level * w),
t AS (SELECT l.*, CASE WHEN o.k IS NULL OR l.k < o.k THEN cap ELSE o.level * w END AS target FROM l, o),
p AS (SELECT d.*, t.source_size, t.target, t.c, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN size > 0 AND place < floor(target) THEN place / target END AS y FROM p)
SELECT doc_id, size, source_size, target,
  CAST(greatest(least(floor(target) - place, size), 0) + greatest(least(floor(target) - source_size - place, size), 0)
   + greatest(least(floor(target) - 2 * source_size - place, size), 0) AS BIGINT) AS taken,
  round(CASE c WHEN 0 THEN 2 * y / (1.5 + sqrt(2.25 - 2 * y))
   WHEN 2 THEN 6 * y / (2 + sqrt(4 + 12 * y))
   ELSE CASE WHEN y <= 0.5 THEN 4 * y / (1 + sqrt(1 + 16 * y)) ELSE 0.5 + 4 * (y - 0.5) / (3 + sqrt(greatest(9 - 16 * (y - 0.5), 0))) END END, 9) AS first_position
FROM f
""",
    "op9_warc_roundtrip": """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) payload_bytes, sha1(h) x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""",
    "op13_hard_negatives": """
WITH q AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
""",
}

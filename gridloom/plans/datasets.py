"""Queries of scans, pairing, splits and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.splits import threshold_hex
from gridloom.operators import loaders as L
from gridloom.operators import shards as S
from gridloom.plans.registry import query, table

#: The number of source shards that orders stand in for, and records a shard.
SHARDS, PER_SHARD = 10, 100_000


@query("SELECT count(*) AS n_rows, CAST(max(label) + 1 AS INTEGER) AS n_classes, CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim FROM embeddings")
def embedding_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, AGG9: rows, classes (greatest label + 1) and width."""
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.count("*").alias("n_rows"), (F.max("label") + 1).alias("n_classes"), F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def json_metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL7, SRC11: typed projection of a JSON payload."""
    k = F.from_json("props", "k int")["k"] % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS number
FROM pages WHERE regexp_matches(url, '^https?://[^/]+/.*$')""")
def path_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2, SRC4, SRT2: base name and numeric suffix of well-formed paths."""
    p = table(spark, sf_dir, "pages").where(F.rlike("url", F.lit("^https?://[^/]+/.*$")))
    number = F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1)
    return p.select("page_id", F.element_at(F.split("url", "/"), -1).alias("base"), F.when(number != "", number.cast("bigint")).alias("number"))


#: The coarse class of the fine classes 0 to 181, in order; what is not listed becomes 0, and 255 is ignored.
COARSE = (
    9, 11, 11, 11, 11, 11, 11, 11, 11, 8, 8, 8, 8, 8, 8, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 6, 6, 6, 6, 6, 6, 6, 6, 10, 10, 10, 10, 10, 10, 10, 10, 10, 10, 5, 5, 5, 5, 5, 5, 5, 5, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2,
    3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 4, 4, 4, 4, 4, 4, 4, 4, 17, 17, 22, 20, 20, 22, 15, 25, 16, 13, 12, 12, 17, 17, 23, 15, 15, 17, 15, 21, 15, 25, 13, 13, 13, 13, 13, 22,
    26, 14, 14, 15, 22, 21, 21, 24, 20, 22, 15, 17, 16, 15, 22, 24, 21, 17, 25, 16, 21, 17, 22, 16, 21, 21, 25, 21, 26, 21, 24, 20, 17, 14, 21, 26, 15, 23, 20, 21, 24, 15, 24, 22, 25, 15, 20, 17, 17, 22,
    14, 18, 18, 18, 18, 18, 18, 18, 26, 26, 19, 19, 24,
)


@query(f"""
SELECT coarse, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM (SELECT p_partkey, CAST(CASE WHEN l = 255 THEN -1 ELSE coalesce(({list(COARSE)!r})[l + 1], 0) END AS INTEGER) AS coarse
FROM (SELECT p_partkey, p_partkey % 256 AS l FROM part)) WHERE coarse > -1 GROUP BY coarse
""")
def label_remap_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL8, FLT3: fine labels 0 to 255 to coarse ones; unmapped give 0, ignored ones go."""
    fine = (F.col("p_partkey") % 256).cast("int")
    coarse = F.when(fine == 255, -1).otherwise(F.coalesce(F.get(F.array(*[F.lit(x) for x in COARSE]), fine), F.lit(0)))
    rows = table(spark, sf_dir, "part").select("p_partkey", coarse.alias("coarse")).where("coarse > -1")
    return rows.groupBy("coarse").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("SELECT i AS class, CAST(sum(CASE WHEN label = i THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum((label >> 1) & 1) AS BIGINT) AS bit_1 FROM embeddings, range(10) t(i) GROUP BY i")
def one_hot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL9, SCL10: sums of one-hot vectors, and of one bit of the label."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    bit = F.shiftright("label", 1).bitwiseAND(1)
    rows = table(spark, sf_dir, "embeddings").select(bit.alias("b"), F.posexplode(hot).alias("class", "h"))
    return rows.groupBy(F.col("class").cast("bigint").alias("class")).agg(F.sum("h").alias("n"), F.sum("b").alias("bit_1"))


@query(f"SELECT CASE WHEN substr(sha256('42:' || doc_id), 1, 16) < '{threshold_hex(0.05)}' THEN 'val' ELSE 'train' END AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 over documents."""
    return S.hash_split(table(spark, sf_dir, "documents"), "doc_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT source, count(*) AS n, CAST(least(count(*) - 1, greatest(1, floor(count(*) * 0.05))) AS BIGINT) AS n_val FROM documents GROUP BY source")
def fraction_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, AGG19: size of the validation prefix of each source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", "n", S.validation_count(F.col("n"), 0.05).alias("n_val"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY substr(sha256('42:' || doc_id), 1, 16), doc_id) k FROM documents) WHERE k <= 50")
def hashed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT3, SRT5: a seeded sample of 50 by hashed order (a sampling operator)."""
    return S.hashed_prefix(table(spark, sf_dir, "documents"), "doc_id", 50).select("doc_id")


@query("SELECT CAST((o_orderkey % 10) % 3 AS INTEGER) AS consumer, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS first FROM orders GROUP BY 1")
def consumer_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAR1, SRC12: shards stride over consumers."""
    o = table(spark, sf_dir, "orders").withColumn("shard", F.col("o_orderkey") % SHARDS)
    return o.groupBy(S.consumer_of(F.col("shard"), SHARDS, 3).alias("consumer")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""WITH s AS (SELECT o_orderkey % 3 AS shard, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1 AS place FROM orders),
o AS (SELECT i, i % 3 AS shard, i // 3 AS owner, CAST(ceil((8 - i % 3) / 3) AS INTEGER) AS owners FROM range(8) t(i))
SELECT CAST(i AS INTEGER) AS consumer, CAST(o.shard AS INTEGER) AS shard, CAST(owner AS INTEGER) AS owner, owners, CAST(greatest(0, ceil((100 - i) / 8)) * 2 AS BIGINT) AS quota, count(*) AS n
FROM o JOIN s ON s.shard = o.shard AND s.place % owners = owner GROUP BY ALL""")
def shared_shard_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAR1, AGG19: eight consumers share three shards of orders; how many rows each owns, and what it owes of 100 batches of 2."""
    owners = S.shared_shards(spark, 3, 8).withColumn("quota", S.consumer_quota(100, F.col("consumer"), 8, 2))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("shard"))
    rows = L.places(o, ["shard"], F.floor(F.col("o_orderkey") / 65536), ["o_orderkey"])
    # The owners are one row a consumer.
    met = rows.join(F.broadcast(owners), "shard").where(F.pmod(F.col("place"), F.col("owners")) == F.col("owner"))
    return met.groupBy("consumer", "shard", "owner", "owners", "quota").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT count(*) AS n, count(*) // 10 AS each, count(*) // 4 AS start, count(*) // 2 // 32 * 32 AS many FROM orders),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders)
SELECT CAST((((ordinal - start) // 8 + 1) * 4 - 1) // (many // 8) AS INTEGER) AS worker, CAST(ordinal // each AS BIGINT) AS shard, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS first
FROM o, n WHERE ordinal >= start AND ordinal < start + many GROUP BY 1, 2""")
def finite_interval_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13, PAR2, PAR4, FLT7: the middle half of all ordinals cut in contiguous batch-aligned slices."""
    o = table(spark, sf_dir, "orders").withColumn("all", F.lit(0))
    n = o.count()
    start, many = n // 4, n // 2 // 32 * 32
    numbered = L.places(o, ["all"], F.floor(F.col("o_orderkey") / 65536), ["o_orderkey"], "ordinal")
    worker = S.slice_of(F.col("ordinal"), start, many, 8, 4)
    shard = F.floor(F.col("ordinal") / (n // 10))
    return S.interval(numbered, start, many).groupBy(worker.alias("worker"), shard.alias("shard")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority g, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 64 AS shard, count(*) OVER (PARTITION BY o_orderpriority) // 64 AS whole FROM orders)
SELECT g AS o_orderpriority, CAST(shard AS BIGINT) AS shard, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS first, CAST(max(o_orderkey) AS BIGINT) AS last FROM o WHERE shard < whole GROUP BY 1, 2""")
def equal_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, AGG20: shards of 64 records; the remainder is retained."""
    rows = S.equal_shards(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 64, bucket=F.floor(F.col("o_orderkey") / 65536))
    return rows.groupBy("o_orderpriority", "shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pair_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI1, JOI2, SRC10: documents with their labels."""
    return S.complete_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'left' ELSE 'right' END AS missing FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def pair_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI2, JOI3, SET4: keys with one part only."""
    return S.incomplete(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def replay_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI4, SRC16, SRC18: what is not yet committed."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.without_replayed(table(spark, sf_dir, "orders"), done, "o_orderkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber % 3 AS stem, max(l_linenumber) AS completed FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT l_orderkey, CAST(stem AS INTEGER) AS stem, completed, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY completed) AS n FROM p) WHERE n > 1""")
def completion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16, JOI2: pairs in the order of their second part, after a skip."""
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("stem"), "l_linenumber")
    return S.completion_order(m, "l_orderkey", "stem", "l_linenumber", 1).withColumn("n", F.col("n").cast("bigint"))


@query("SELECT split_part(url, '/', 3) AS host, arg_min(url, page_id) AS url FROM pages GROUP BY 1")
def manifest_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15, SET1: the first entry of a name."""
    p = table(spark, sf_dir, "pages").withColumn("host", F.get(F.split("url", "/"), F.lit(2)))
    return S.first_wins(p, "host", "url", "page_id")


@query("SELECT count(*) AS n_requested, CAST(count(p.page_id) AS BIGINT) AS n_found FROM range(0, 100) t(i) LEFT JOIN pages p ON p.page_id = i")
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI5, SET3: requested names against the manifest."""
    return spark.range(100).join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(1).alias("f")), "id", "left").agg(F.count("*").alias("n_requested"), F.count("f").alias("n_found"))


@query("SELECT o_custkey, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI12: the newest entry, ties by name."""
    return S.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13: keys that are not unique."""
    return S.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""WITH e AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w = role THEN 0 ELSE 1 END b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CAST(i AS BIGINT) AS island, any_value(role) AS role, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) i FROM e) GROUP BY 1, 2""")
def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5: runs of equal values."""
    rows = S.islands(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")
    return rows.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL11, SNK2: content keys."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))

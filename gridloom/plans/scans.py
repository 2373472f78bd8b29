"""Queries of file scans, manifests, shards, loaders, registries and streams, on files and lines made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.splits import threshold_hex
from gridloom.operators import loaders as L
from gridloom.operators import streams as T
from gridloom.plans.registry import query, table
from gridloom.session import fresh_folder
from gridloom.sinks import shards as K
from gridloom.sources import registry as R
from gridloom.sources import scans as C
from gridloom.sources.shards import ShardSource
from gridloom.streaming import resume

SHARDS = 10


@query("""
WITH p AS (SELECT DISTINCT 'data/sa_' || d.doc_id AS stem, 'sa_' || d.doc_id AS name FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
o AS (SELECT *, row_number() OVER (ORDER BY substr(sha256('42:' || name), 1, 16), name) AS k, count(*) OVER () AS n FROM p)
SELECT stem, stem || '.jpg' AS path FROM o WHERE k <= least(n - 1, greatest(1, floor(n * 0.05)))
""")
def pair_directory_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: images with a partner file, in seeded hash order, and the validation prefix of them."""
    at = lambda name, end: table(spark, sf_dir, name).select(F.concat(F.lit("data/sa_"), "doc_id", F.lit(end)).alias("path"))
    listing = at("documents", ".jpg").unionByName(at("labels", ".json"))
    return C.split_pairs(C.paired(listing), "val")


@query("""
SELECT s AS split_dir, 'root/images/' || s || '/' || doc_id || '.jpg' AS image, 'root/annotations/' || s || '/' || doc_id || '.png' AS label
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'val2017' ELSE 'train2017' END AS s FROM documents)
""")
def list_scan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: list lines with trailing blanks to image and label paths; both splits as one."""
    part = F.when(F.col("doc_id") % 3 == 0, "val2017").otherwise("train2017")
    lines = table(spark, sf_dir, "documents").select(part.alias("split_dir"), F.concat("doc_id", F.lit(" \t\r")).alias("value"))
    return C.from_lists(lines, "root", ["train2017", "val2017"])


@query("""
SELECT page_id, 'root/gtFine/train/city' || page_id % 7 || '/page_' || page_id || '_labelTrainIds.png' AS label FROM pages
""")
def city_label_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: label paths of images two folders down; the name ends at its first dot."""
    image = F.concat(F.lit("root/leftImg8bit/train/city"), F.col("page_id") % 7, F.lit("/page_"), "page_id", F.lit(".v1.png"))
    return table(spark, sf_dir, "pages").select("page_id", C.label_path(image).alias("label"))


@query("""
SELECT 'host' || page_id % 20 || '.tar' AS file_name, 'https://x/' || min(page_id) AS cdn_link, CAST(min(page_id) + 1 AS BIGINT) AS line
FROM pages WHERE page_id % 5 <> 0 GROUP BY page_id % 20
""")
def manifest_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: a tab-separated manifest with a byte-order mark, blanks, other files and repeated names."""
    end = F.when(F.col("page_id") % 5 == 0, ".txt").otherwise(".tar")
    value = F.concat(F.lit("7\t https://x/"), "page_id", F.lit(" \t host"), F.col("page_id") % 20, end, F.lit(" \r"))
    rows = table(spark, sf_dir, "pages").select(value.alias("value"), (F.col("page_id") + 1).alias("line"))
    head = spark.range(1).select(F.lit("﻿size\tcdn_link\tfile_name\r").alias("value"), (F.col("id") - 1).alias("line"))
    return C.manifest(rows.unionByName(head)).select("file_name", "cdn_link", F.col("line").cast("bigint").alias("line"))


_LEGACY = "WITH k AS (SELECT 'sa_' || o_orderkey AS key, o_orderkey % 3 AS source, o_orderkey AS n FROM orders)"


@query(f"""
{_LEGACY}, s AS (SELECT key FROM k WHERE source = 1 ORDER BY n LIMIT 100)
SELECT key FROM k WHERE (source > 1 OR (source = 1 AND n > 0)) AND key NOT IN (SELECT key FROM s)
""")
def legacy_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18: an old cursor counted sorted ids; its first 100 of the second source become a set to leave out."""
    o = F.col("o_orderkey")
    pairs = table(spark, sf_dir, "orders").select(F.concat(F.lit("sa_"), o).alias("key"), (o % 3).alias("source"), o.alias("n"))
    skip = C.legacy_skip(pairs.where("source = 1"), 100)
    return C.resumed(pairs, 1, (1, 0), skip).select("key")


@query("""
WITH i AS (SELECT conv_id, turn, 'frames/' || conv_id || '/' || lpad(CAST(turn AS VARCHAR), 5, '0') AS p, role FROM conversations),
f AS (SELECT conv_id, p, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS frame FROM i),
m AS (SELECT conv_id, p, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS frame FROM i WHERE role = 'user')
SELECT CAST(f.conv_id AS VARCHAR) AS sequence, CAST(f.frame AS INTEGER) AS frame, f.p || '.jpg' AS image, coalesce(m.p || '.png', '-1') AS mask
FROM f LEFT JOIN m ON m.conv_id = f.conv_id AND m.frame = f.frame
""")
def video_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19, SRC22: sorted frames of named sequences, masks padded to their number."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("sequence"), "role", F.concat(F.lit("frames/"), "conv_id", F.lit("/"), F.lpad(F.col("turn").cast("string"), 5, "0")).alias("p"))
    path = lambda rows, end: rows.select("sequence", F.concat("p", F.lit(end)).alias("path"))
    names = c.select(F.concat("sequence", F.lit(" ")).alias("sequence")).distinct()
    return C.catalogue(names, path(c, ".jpg"), path(c.where("role = 'user'"), ".png"))


@query("SELECT p_partkey, CAST(p_size % 256 AS INTEGER) AS red, CAST(p_partkey % 256 AS INTEGER) AS green, CAST(p_size * 5 % 256 AS INTEGER) AS blue FROM part")
def palette_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC23: lines of three integers as colours."""
    line = F.concat_ws(" ", F.col("p_size") % 256, F.col("p_partkey") % 256, F.concat(F.col("p_size") * 5 % 256, F.lit("\n")))
    return C.palette_text(table(spark, sf_dir, "part").select("p_partkey", line.alias("value")), keep=["p_partkey"])


@query("""
SELECT stem, string_agg(part, ',' ORDER BY part) AS parts FROM (SELECT 'sa_' || doc_id AS stem, 'jpg' AS part FROM documents WHERE n_chars > 0
UNION SELECT 'sa_' || doc_id, 'json' FROM labels WHERE quality > 0) GROUP BY stem
""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC25: the kinds of non-empty files of each stem."""
    at = lambda name, end, size: table(spark, sf_dir, name).select(F.concat(F.lit("out/sa_"), "doc_id", F.lit(end)).alias("path"), F.col(size).cast("bigint").alias("length"))
    files = at("documents", ".jpg", "n_chars").unionByName(at("labels", ".json", "quality")).unionByName(at("labels", ".json.part", "quality"))
    return C.inventory(files).select("stem", F.array_join("parts", ",").alias("parts"))


@query("SELECT 'a/' || page_id || '.JPG' AS path FROM pages WHERE page_id % 2 = 0 ORDER BY path LIMIT 12")
def preview_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC26: the first twelve images by path (a preview); other kinds of files are left out."""
    end = F.when(F.col("page_id") % 2 == 0, ".JPG").otherwise(".txt")
    return C.preview(table(spark, sf_dir, "pages").select(F.concat(F.lit("a/"), "page_id", end).alias("path")), 12)


def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, key, jpg, json) of all pages in the order of their ids."""
    pages = table(spark, sf_dir, "pages").withColumn("_all", F.lit(0))
    rows = L.places(pages, ["_all"], F.floor(F.col("page_id") / 65536), ["page_id"], "ordinal")
    return rows.select("ordinal", F.concat(F.lit("sa_"), "page_id").alias("key"), F.coalesce("html", F.lit("")).cast("binary").alias("jpg"), F.to_json(F.struct("url")).cast("binary").alias("json"))


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS k FROM pages)
SELECT 'sa_' || page_id AS key, 'shard-' || lpad(CAST(k // 64 AS VARCHAR), 6, '0') || '.tar' AS shard, sha256(coalesce(html, '')) AS digest, url FROM o
""")
def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK3, SRC6, SRC9, SRC10: all pages as tar shards of 64 with a committed state, written twice (the second finds nothing to do) and read back."""
    folder = fresh_folder(spark, "shards")
    samples = page_samples(spark, sf_dir)
    first = K.write_shards(samples, folder, 64, {"kind": "pages"}, ["pages"], keep_remainder=True)
    if K.write_shards(samples, folder, 64, {"kind": "pages"}, ["pages", "more"], keep_remainder=True)["shards"] != first["shards"]:
        raise ValueError("a second run changed committed shards")
    spark.dataSource.register(ShardSource)
    rows = spark.read.format("tarshards").load(folder)
    return rows.select("key", C.base_name(F.col("url")).alias("shard"), F.sha2("jpg", 256).alias("digest"), F.get_json_object(F.col("json").cast("string"), "$.url").alias("url"))


@query("SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT 'jpg' AS kind, octet_length(encode(coalesce(html, ''))) AS size FROM pages UNION ALL SELECT 'saved', 1 FROM pages) GROUP BY kind")
def file_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: samples as flat files, twice; what is there already is left alone."""
    folder = fresh_folder(spark, "files")
    samples = page_samples(spark, sf_dir)
    saved = K.extract_files(samples, folder).agg(F.count_if("saved")).first()[0] + K.extract_files(samples, folder).agg(F.count_if("saved")).first()[0]
    sizes = C.files(spark, folder, "*.jpg").agg(F.lit("jpg").alias("kind"), F.count("*").alias("n"), F.sum("length").alias("bytes"))
    return sizes.unionByName(spark.range(1).select(F.lit("saved").alias("kind"), F.lit(saved).cast("bigint").alias("n"), F.lit(saved).cast("bigint").alias("bytes")))


_SAMPLES = f"""WITH s AS (SELECT o_orderkey AS key, o_orderkey % {SHARDS} AS shard, row_number() OVER (PARTITION BY o_orderkey % {SHARDS} ORDER BY o_orderkey) - 1 AS place,
 substr(sha256('42:' || o_orderkey), 1, 16) < '{threshold_hex(0.05)}' AS val FROM orders),"""


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, place, key) of all orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % SHARDS).alias("shard"))
    return L.places(o, ["shard"], F.floor(F.col("key") / 65536), ["key"])


@query(f"""{_SAMPLES}
c AS (SELECT *, CAST(shard % 4 AS INTEGER) AS consumer FROM s WHERE val),
n AS (SELECT consumer, count(*) AS n FROM c GROUP BY consumer),
q AS (SELECT CAST(i AS INTEGER) AS consumer, greatest(0, CAST(ceil((500 - i % 2) / 2) AS BIGINT)) * 3 AS quota FROM range(4) t(i)),
p AS (SELECT c.*, n.n, q.quota, row_number() OVER (PARTITION BY c.consumer ORDER BY shard, place) - 1 AS r FROM c JOIN n USING (consumer) JOIN q USING (consumer))
SELECT consumer, key, CAST(sum(1) AS BIGINT) AS times, CAST(min(r + k * n) AS BIGINT) AS first FROM p, range(0, 2000) x(k) WHERE r + k * n < quota GROUP BY consumer, key
""")
def cycling_val_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, SRC14, STR1: four consumers pass over their validation samples until their quotas of 250 batches of three."""
    rows = L.cycling_stream(order_samples(spark, sf_dir), SHARDS, "val", 500, 3, world=2, workers=2)
    return rows.groupBy("consumer", "key").agg(F.count("*").alias("times"), F.min("position").alias("first"))


@query(f"""{_SAMPLES}
o AS (SELECT CAST(i AS INTEGER) AS consumer, CAST(i % {SHARDS} AS BIGINT) AS shard, i // {SHARDS} AS owner, CAST(ceil((12 - i % {SHARDS}) / {SHARDS}) AS INTEGER) AS owners FROM range(12) t(i)),
c AS (SELECT s.*, o.consumer FROM s JOIN o ON o.shard = s.shard AND s.place % o.owners = o.owner WHERE NOT s.val),
n AS (SELECT consumer, count(*) AS n FROM c GROUP BY consumer),
p AS (SELECT c.*, n.n, k, row_number() OVER (PARTITION BY c.consumer, k ORDER BY sha256('42:' || k || ':' || key), key) - 1 + k * n.n AS position FROM c JOIN n USING (consumer), range(0, 6) x(k))
SELECT consumer, count(*) AS n, CAST(max(position) AS BIGINT) AS last, CAST(sum(key * (position % 1000)) AS BIGINT) AS mark FROM p WHERE position < (SELECT count(*) // 10 * 2 FROM orders) GROUP BY consumer
""")
def cycling_train_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, PAR1: twelve consumers share ten shards for two to five passes; each pass over the train split comes in an order of its own."""
    rows = L.cycling_stream(order_samples(spark, sf_dir), SHARDS, "train", table(spark, sf_dir, "orders").count() // 10, 2, world=12)
    return rows.groupBy("consumer").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.sum(F.col("key") * (F.col("position") % 1000)).alias("mark"))


@query(f"""{_SAMPLES}
o AS (SELECT key, shard * 100000 + place AS ordinal FROM s)
SELECT CAST((ordinal - 200000) // 50000 AS INTEGER) AS rank, CAST(((((ordinal - 200000) % 50000) // 5 + 1) * 4 - 1) // 10000 AS INTEGER) AS worker, count(*) AS n, CAST(min(key) AS BIGINT) AS first
FROM o WHERE ordinal BETWEEN 200000 AND 299999 GROUP BY 1, 2
""")
def finite_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13, SRC14: the finite loader of two ranks of four workers."""
    options = {"shards": SHARDS, "world_size": 2, "workers": 4, "train_samples": 200_000, "val_samples": 100_000, "samples_per_shard": 100_000, "batch_size": 5}
    _, val = R.make_loaders(order_samples(spark, sf_dir).withColumn("json", F.lit("")), options | {"batch_size": 5})
    return val.groupBy("rank", "worker").agg(F.count("*").alias("n"), F.min("key").alias("first"))


@query("SELECT n_nationkey, round(avg(c_acctbal), 3) AS balance, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def result_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6, SRC24: a result table as CSV with three decimals, computed once and read from its file the second time."""
    path = f"{fresh_folder(spark, 'results')}/global"

    def compute() -> list[DataFrame]:
        c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
        return [c.join(table(spark, sf_dir, "nation"), "n_nationkey").groupBy("n_nationkey").agg(F.avg("c_acctbal").alias("balance"), F.count("*").alias("n"))]

    def never() -> list[DataFrame]:
        raise ValueError("a cached result was computed again")

    T.cached_results([path], compute, spark)
    (out,) = T.cached_results([path], never, spark)
    return out.select("n_nationkey", F.col("balance").cast("double").alias("balance"), F.col("n").cast("bigint").alias("n"))


_MODELS = ", ".join(f"('{name}', '{names[0]}', {patch}, {dim})" for names, patch, dim in R.FEATURIZERS for name in names)


@query(f"""
WITH m(name, canonical, patch_size, dim) AS (VALUES {_MODELS})
SELECT s_suppkey, m.canonical, CAST(m.patch_size AS INTEGER) AS patch_size, CAST(m.dim AS INTEGER) AS dim, CAST(CASE WHEN contains(m.name, 'dinov2') THEN 14 ELSE 16 END AS INTEGER) AS kernel
FROM supplier JOIN m ON m.name = CASE s_suppkey % 4 WHEN 0 THEN 'dinov2' WHEN 1 THEN 'dinov3b' WHEN 2 THEN 'siglip2' ELSE 'dinov3_splus' END
""")
def featurizer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF2, SCL25: names in any case and their aliases to model, patch size, width and kernel."""
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, "DINOv2").when(k == 1, "dinov3b").when(k == 2, "SigLIP2").otherwise("dinov3_splus")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower(name).alias("name")).join(R.featurizers(spark), "name")
    return rows.select("s_suppkey", "canonical", "patch_size", "dim", R.kernel_size(F.col("name")).alias("kernel"))


@query("""
SELECT s_suppkey, 'dinov2_cross_depth' || s_suppkey % 5 || '_loadsize_224_upsample_size_448_sa1b_attention_tv_0.0_sam_alpha_0.8_sam_reg_' || s_suppkey % 2 || '_RGB_False_clamp_True' AS name,
 '20240131T235959Z-' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 8) AS run FROM supplier
""")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL14: names of experiments from their settings, and run ids of a time and eight hex digits."""
    k = F.col("s_suppkey")
    fixed = {"model_type": "dinov2", "upsampler_type": "cross", "load_size": 224, "upsample_size": 448, "dataset": "sa1b", "downsampler_type": "attention", "tv_weight": "0.0", "sam_mask_alpha": "0.8", "color_feats": "False", "clamp_featup": "True"}
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 5).alias("upsampler_num_layers"), (k % 2).cast("string").alias("sam_mask_reg"), *[F.lit(v).alias(n) for n, v in fixed.items()])
    at = F.to_timestamp(F.lit("2024-01-31 23:59:59"))
    return rows.select("s_suppkey", R.experiment_name().alias("name"), R.run_id(at, F.md5(k.cast("string"))).alias("run"))


@query("SELECT doc_id, md5(text) AS text, CAST(coalesce(n_chars, 0) * 2 AS BIGINT) AS target FROM documents")
def record_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF1: a caller's two functions on each record, as expressions of the plan."""
    hooks = R.Hooks(F.md5, lambda n: (F.coalesce(n, F.lit(0)) * 2).cast("bigint"))
    return hooks.apply(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars").alias("target")), "text", "target")


@query("SELECT o_orderkey % 3 AS shard, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3: a stream over three shards, run again with its checkpoint lost; the sink by shard repeats nothing."""
    root = fresh_folder(spark, "stream")
    for k in range(3):
        table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == k).select("o_orderkey").coalesce(1).write.parquet(f"{root}/in", mode="append")
    for place in ("one", "two"):
        resume.write_once(resume.stream_shards(spark, f"{root}/in", "o_orderkey bigint", 1), f"{root}/out", f"{root}/{place}")
    return spark.read.parquet(f"{root}/out").groupBy((F.col("o_orderkey") % 3).alias("shard")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT CAST(user_id % 4 AS BIGINT) AS epoch, count(*) AS n, round(avg(CASE WHEN event_id % 5 = user_id % 5 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM events GROUP BY 1")
def stream_running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: running counts and accuracies of a stream, one row of state an epoch."""
    root = fresh_folder(spark, "accuracy")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("epoch"), (F.col("event_id") % 5).alias("label"), (F.col("user_id") % 5).alias("pred"))
    e.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    resume.running_accuracy(stream, f"{root}/out", f"{root}/place")
    return spark.read.parquet(f"{root}/out").select(F.col("epoch").cast("bigint").alias("epoch"), "n", F.round("accuracy", 9).alias("accuracy"))

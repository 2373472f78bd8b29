"""Queries of streams over shards and pairs, of images of labels, and of archives of arrays."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.registry import query, table
from gridloom.plans.scans import page_samples
from gridloom.session import fresh_folder
from gridloom.sinks import shards as K
from gridloom.sources import label_images as I
from gridloom.sources.arrays import ArraySource
from gridloom.sources.npz_sink import write_arrays
from gridloom.sources.shard_stream import ShardStream
from gridloom.streaming import pairs as P


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'pair' END AS status,
 CAST(CASE WHEN l.doc_id IS NULL THEN octet_length(encode(d.text)) END AS BIGINT) AS held, CASE WHEN l.doc_id IS NOT NULL THEN md5(d.text) END AS digest, l.quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE length(d.text) > 0
""")
def stream_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI2, SRC16: texts and labels as halves in shuffled order on a stream; pairs as they are complete, and the halves that the state still holds."""
    root = fresh_folder(spark, "pairs")
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.lit("jpg").alias("kind"), F.col("text").cast("binary").alias("payload"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("json").alias("kind"), F.to_json(F.struct("quality")).cast("binary").alias("payload"))
    # Each half in a file by a hash of its own, so that partners come in different micro-batches, either first.
    members = docs.unionByName(labels).withColumn("file", F.pmod(F.xxhash64("doc_id", "kind"), F.lit(4)))
    for k in range(4):
        members.where(F.col("file") == k).drop("file").write.mode("append").parquet(f"{root}/in/{k}")
    stream = spark.readStream.schema("doc_id bigint, kind string, payload binary").option("recursiveFileLookup", "true").parquet(f"{root}/in")
    P.write_pairs(stream, f"{root}/out", f"{root}/place", ["doc_id"])
    pairs = spark.read.parquet(f"{root}/out").select("doc_id", F.lit("pair").alias("status"), F.lit(None).cast("bigint").alias("held"), F.md5("jpg").alias("digest"), F.get_json_object(F.col("json").cast("string"), "$.quality").cast("int").alias("quality"))
    left = P.halves_left(spark, f"{root}/place")
    return pairs.unionByName(left.select("doc_id", F.lit("left").alias("status"), F.col("bytes").cast("bigint").alias("held"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("int").alias("quality")))


@query("""
WITH o AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS k, count(*) OVER () AS n FROM pages)
SELECT 'sa_' || page_id AS key, count(*) AS times, CAST(min(k + p * n) AS BIGINT) AS first, CAST(max(k + p * n) AS BIGINT) AS last, CAST(max(p) AS INTEGER) AS pass
FROM o, range(0, 3) t(p) WHERE k + p * n < 5 * n // 2 GROUP BY page_id
""")
def shard_stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, STR1, STR3: a stream of two and a half passes over all pages' shards, stopped on its way and started again from its checkpoint."""
    root = fresh_folder(spark, "passes")
    state = K.write_shards(page_samples(spark, sf_dir), f"{root}/shards", 64, {"kind": "pages"}, ["pages"], keep_remainder=True)
    n = sum(s["samples"] for s in state["shards"])
    spark.dataSource.register(ShardStream)

    def started():
        source = spark.readStream.format("tarshardstream").options(quota=5 * n // 2, step=-(-n // 3), progress=f"{root}/progress.json").load(f"{root}/shards")
        return source.select("pass", "position", "key").writeStream.format("parquet").option("checkpointLocation", f"{root}/place").start(f"{root}/out")

    first = started()
    while first.isActive and not (first.lastProgress and first.lastProgress["batchId"] >= 1):
        time.sleep(0.1)
    first.stop()
    second = started()
    second.processAllAvailable()
    second.stop()
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("key").agg(F.count("*").alias("times"), F.min("position").alias("first"), F.max("position").alias("last"), F.max("pass").alias("pass"))


_LABELS = "SELECT 'video-' || vec_id // 500 AS sequence, lpad(CAST(vec_id % 500 // 100 AS VARCHAR), 5, '0') AS frame, CAST(vec_id % 100 // 10 AS INTEGER) AS r, CAST(vec_id % 10 AS INTEGER) AS c, CASE WHEN vec_id % 13 = 0 THEN 255 ELSE label END AS label FROM embeddings"


def label_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence, frame, r, c, label) of all vectors: five frames of 10 x 10 pixels a sequence, with void pixels; the last frame may lack some."""
    i = F.col("vec_id")
    part = lambda x: F.floor(x).cast("int")
    label = F.when(i % 13 == 0, I.VOID).otherwise(F.col("label")).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("video-"), F.floor(i / 500)).alias("sequence"), F.lpad(part(i % 500 / 100).cast("string"), 5, "0").alias("frame"), part(i % 100 / 10).alias("r"), (i % 10).cast("int").alias("c"), label.alias("label"))


@query(f"WITH p AS ({_LABELS}) SELECT sequence, frame, r, c, CAST(CASE WHEN label = 255 THEN 0 ELSE label END AS INTEGER) AS object, label = 255 AS is_void FROM p")
def label_image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20, SRC21, SNK5, FLT5: planes of labels as indexed images with all five line filters, written and read back, void apart."""
    folder = fresh_folder(spark, "labels")
    pixels = label_planes(spark, sf_dir)
    palette = bytes(v for k in range(256) for v in (k, 255 - k, k ^ 85))
    I.write_label_images(pixels, folder, palette, size=(10, 10)).agg(F.sum("bytes")).collect()
    return I.object_masks(I.read_results(spark, folder, pixels.select("sequence", "frame")))


@query(f"""WITH p AS ({_LABELS}), f AS (SELECT * FROM p WHERE frame = '00000'), m AS (SELECT sequence, max(label) AS classes FROM f WHERE r % 2 = 1 AND c % 2 = 1 GROUP BY 1)
SELECT f.sequence, CAST(r // 2 AS INTEGER) AS r, CAST(c // 2 AS INTEGER) AS c, CAST(label AS INTEGER) AS label, CAST(classes + 1 AS INTEGER) AS classes FROM f JOIN m USING (sequence) WHERE r % 2 = 1 AND c % 2 = 1""")
def first_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC22, SCL10, IMG2: the first label image of every sequence at half its size, one-hot by its own classes."""
    folder = fresh_folder(spark, "first")
    I.write_label_images(label_planes(spark, sf_dir), folder, bytes(768), size=(10, 10)).agg(F.sum("bytes")).collect()
    soft = I.first_segmentation(I.label_images(spark, folder), 2, (10, 10))
    return soft.select("sequence", "r", "c", (F.array_position("soft", F.lit(1.0)) - 1).cast("int").alias("label"), F.size("soft").alias("classes"))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings)
SELECT k AS row, vec_id AS id, CAST(label AS INTEGER) AS label, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM o WHERE k < n * 3 // 4""")
def array_archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, FLT7: all embeddings as an archive of arrays, of which the first three quarters are read back in partitions of 128 rows."""
    folder = fresh_folder(spark, "arrays")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("feats"), F.col("label").alias("labels"))
    n = write_arrays(e, f"{folder}/features.npz", ["vec_id"], {"feats": "<f4", "labels": "<i4", "vec_id": "<i8"})
    spark.dataSource.register(ArraySource)
    rows = spark.read.format("npz").options(arrays="feats,labels,vec_id", num_limit=n * 3 // 4, rows_per_partition=128).load(f"{folder}/features.npz")
    total = F.aggregate("feats", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("row", F.col("vec_id").alias("id"), F.col("labels").alias("label"), F.size("feats").alias("width"), F.round(total, 6).alias("total"))

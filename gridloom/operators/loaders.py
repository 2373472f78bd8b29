"""Streams of samples for consumers: two-level places, finite intervals and cycling splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.splits import is_validation
from gridloom.operators import shards as S


def places(rows: DataFrame, group: list[str], bucket: Column | None, order: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place in its group, from 0, where ``bucket`` never falls along ``order``.

    Rows are numbered inside a bucket, and buckets' sizes are summed over the narrow table of buckets, so a
    group of any size spreads over its buckets. Without a bucket a group is one, in one exchange.
    """
    if bucket is None:
        return rows.withColumn(name, (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).cast("bigint"))
    rows = rows.withColumn("_bucket", bucket)
    own = [*group, "_bucket"]
    sizes = rows.groupBy(*own).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(own)], F.coalesce(before, F.lit(0)).alias("_start"))
    same = [rows[c].eqNullSafe(starts[f"_g{k}"]) for k, c in enumerate(own)]
    place = F.col("_start") + F.row_number().over(W.partitionBy(*own).orderBy(*order)) - 1
    return rows.join(starts, same).withColumn(name, place.cast("bigint")).drop("_bucket", "_start", *[f"_g{k}" for k in range(len(own))])


def finite_stream(samples: DataFrame, per_shard: int, start: int, count: int, batch: int, world: int = 1, workers: int = 1) -> DataFrame:
    """Adds (ordinal, rank, worker): samples (shard, place) of the interval, a contiguous batch-aligned slice each."""
    if min(per_shard, batch, world, workers) < 1 or start < 0 or count < 1 or count % (batch * world):
        raise ValueError("sizes must be positive, and the interval whole batches for every rank")
    rows = S.interval(samples.withColumn("ordinal", (F.col("shard") * per_shard + F.col("place")).cast("bigint")), start, count)
    each = count // world
    rank = F.floor((F.col("ordinal") - start) / each).cast("int")
    return rows.withColumn("rank", rank).withColumn("worker", S.slice_of(F.col("ordinal"), F.lit(start) + F.col("rank") * each, each, batch, workers))


def short_shards(samples: DataFrame, per_shard: int, shards: int) -> DataFrame:
    """(shard, n) of the shards of an interval that do not hold ``per_shard`` samples; a finite stream needs none."""
    n = samples.groupBy("shard").agg(F.count("*").alias("n"))
    every = samples.sparkSession.range(shards).select(F.col("id").alias("shard"))
    return every.join(n, "shard", "left").na.fill(0, ["n"]).where(F.col("n") != per_shard)


def assignments(spark, shards: int, consumers: int) -> DataFrame:
    """(consumer, shard, offset, stride): shards stride over consumers, or consumers share shards by stride."""
    if min(shards, consumers) < 1:
        raise ValueError("there must be a shard and a consumer")
    if consumers <= shards:
        shard = F.col("id")
        return spark.range(shards).select(F.pmod(shard, F.lit(consumers)).cast("int").alias("consumer"), shard.alias("shard"), F.lit(0).alias("offset"), F.lit(1).alias("stride"))
    return S.shared_shards(spark, shards, consumers).select("consumer", F.col("shard").cast("bigint").alias("shard"), F.col("owner").alias("offset"), F.col("owners").alias("stride"))


def cycling_stream(samples: DataFrame, shards: int, split: str, batches: int, batch: int, world: int = 1, workers: int = 1, val_fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """(consumer, position, pass, and the sample's columns): each consumer passes over its samples of the split until its quota.

    samples: (shard, place, key, ...). Train passes come in a hashed order of their own each, val passes in
    shard order. A consumer with a quota but no sample is an error. A pass of one consumer is one group.
    """
    if split not in ("train", "val") or not 0 < val_fraction < 1:
        raise ValueError("use split train or val and 0 < val_fraction < 1")
    if min(batches, batch, world, workers) < 1:
        raise ValueError("sizes must be positive")
    spark = samples.sparkSession
    part = is_validation(F.col("key"), val_fraction, seed)
    own = samples.where(part if split == "val" else ~part).join(assignments(spark, shards, world * workers), "shard")
    own = own.where(F.pmod(F.col("place"), F.col("stride")) == F.col("offset")).drop("offset", "stride")
    quota = S.consumer_quota(batches, F.pmod(F.col("consumer"), F.lit(workers)), workers, batch)
    consumers = spark.range(world * workers).select(F.col("id").cast("int").alias("consumer")).withColumn("_quota", quota).where("_quota > 0")
    sizes = own.groupBy("consumer").agg(F.count("*").alias("_n"))
    none = F.raise_error(F.concat(F.lit(f"no {split} samples for consumer "), F.col("consumer"))).cast("bigint")
    needs = consumers.join(sizes, "consumer", "left").withColumn("_n", F.when(F.col("_n").isNull(), none).otherwise(F.col("_n")))
    rows = own.join(needs, "consumer").withColumn("pass", F.explode(F.sequence(F.lit(0), F.floor((F.col("_quota") - 1) / F.col("_n")).cast("int"))))
    order = [F.sha2(F.concat_ws(":", F.lit(seed), F.col("pass"), F.col("key")), 256), F.col("key")] if split == "train" else [F.col("shard"), F.col("place")]
    position = F.col("pass") * F.col("_n") + F.row_number().over(W.partitionBy("consumer", "pass").orderBy(*order)) - 1
    return rows.withColumn("position", position).where("position < _quota").drop("_n", "_quota")

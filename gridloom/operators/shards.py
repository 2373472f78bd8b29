"""Dataset preparation: pairing, splits, shards, ranges and manifests as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.splits import hash_hex, is_validation


def hash_split(rows: DataFrame, key: str, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split``: val or train, from the key's hash alone; no shuffle."""
    return rows.withColumn("split", F.when(is_validation(F.col(key), fraction, seed), "val").otherwise("train"))


def validation_count(n: Column, fraction: float) -> Column:
    """min(n - 1, max(1, int(n * fraction)))."""
    return F.least(n - 1, F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))).cast("bigint")


def hashed_prefix(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in hashed order: a seeded shuffle and cap that does not depend on input order."""
    return rows.orderBy(hash_hex(F.col(key), seed), key).limit(n)


def consumer_of(shard: Column, shards: int, consumers: int) -> DataFrame:
    """The consumer that strides onto a shard when there are at least as many shards."""
    if not 0 < consumers <= shards:
        raise ValueError("striding needs at least one shard a consumer")
    return F.pmod(shard, F.lit(consumers)).cast("int")


def shared_shards(spark, shards: int, consumers: int) -> DataFrame:
    """(consumer, shard, owner, owners) where consumers outnumber shards and share them."""
    c = F.col("id").cast("int")
    owner = F.floor(c / shards).cast("int")
    return spark.range(consumers).select(
        c.alias("consumer"), F.pmod(c, F.lit(shards)).cast("int").alias("shard"), owner.alias("owner"),
        F.ceil((F.lit(consumers) - F.pmod(c, F.lit(shards))) / shards).cast("int").alias("owners"),
    )


def consumer_quota(batches: int, worker: Column, workers: int, batch_size: int) -> Column:
    """Records a worker owes: its strided share of batches."""
    return (F.greatest(F.lit(0), F.ceil((F.lit(batches) - worker) / workers)) * batch_size).cast("bigint")


def ordinals(rows: DataFrame, shard: str, order: list[str], per_shard: int) -> DataFrame:
    """Adds the global ordinal shard * per_shard + place; a shard, which is bounded, is one group."""
    place = F.row_number().over(W.partitionBy(shard).orderBy(*order)) - 1
    return rows.withColumn("ordinal", (F.col(shard) * per_shard + place).cast("bigint"))


def interval(rows: DataFrame, start: int, count: int) -> DataFrame:
    """Ordinals in [start, start + count)."""
    if start < 0 or count <= 0:
        raise ValueError("an interval starts at 0 or later and is not empty")
    return rows.where(F.col("ordinal").between(start, start + count - 1))


def slice_of(ordinal: Column, start: int | Column, count: int, batch: int, workers: int) -> Column:
    """The worker whose contiguous, batch-aligned slice of the interval holds an ordinal."""
    if count % batch:
        raise ValueError("the interval must be whole batches")
    batches = count // batch
    at = F.floor((ordinal - start) / F.lit(batch))
    return F.floor(((at + 1) * workers - 1) / batches).cast("int")


def equal_shards(rows: DataFrame, group: str, order: list[str], size: int, keep_remainder: bool = False, bucket: Column | None = None) -> DataFrame:
    """Adds ``shard``: consecutive groups of ``size`` rows inside each source group; a last partial one is kept or left.

    ``bucket`` never falls along ``order`` and spreads a group over tasks; without it a group is one.
    """
    from gridloom.operators.loaders import places

    rows = places(rows, [group], bucket, order, "_place")
    rows = rows.withColumn("shard", F.floor(F.col("_place") / size).cast("bigint")).drop("_place")
    if keep_remainder:
        return rows
    whole = rows.groupBy(F.col(group).alias("_of")).agg(F.floor(F.count("*") / size).alias("_whole"))
    return rows.join(whole, F.col(group).eqNullSafe(F.col("_of"))).where("shard < _whole").drop("_whole", "_of")


def complete_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key."""
    return left.join(right, key)


def incomplete(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, missing): keys that only one side has."""
    sides = left.select(key).distinct().withColumn("l", F.lit(True)).join(right.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    return sides.where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "left").otherwise("right").alias("missing"))


def completion_order(members: DataFrame, archive: str, stem: str, place: str, skip: int = 0) -> DataFrame:
    """Pairs in the order of their second part, without the first ``skip`` of each archive."""
    pairs = members.groupBy(archive, stem).agg(F.max(place).alias("completed"), F.count("*").alias("parts")).where("parts >= 2")
    n = F.row_number().over(W.partitionBy(archive).orderBy("completed"))
    return pairs.withColumn("n", n).where(F.col("n") > skip).drop("parts")


def without_replayed(rows: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not committed."""
    return rows.join(committed.select(key).distinct(), key, "left_anti")


def first_wins(rows: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """One value a name, that of the smallest order."""
    return rows.groupBy(name).agg(F.min_by(value, order).alias(value))


def latest(rows: DataFrame, group: str, path: str, time: str) -> DataFrame:
    """The path of the newest entry of a group; ties go to the greater path."""
    return rows.groupBy(group).agg(F.max(F.struct(F.col(time).alias("t"), F.col(path).alias("p"))).alias("m")).select(group, F.col("m.p").alias(path))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def islands(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds ``island``: the number of the run of equal consecutive values."""
    by = W.partitionBy(group).orderBy(order)
    change = F.coalesce((F.col(value) != F.lag(value).over(by)).cast("int"), F.lit(0))
    return rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(by)).drop("_change")

"""A uniform shuffle of all rows into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks of a bounded number of rows. How many of a block's rows go to each shard is drawn exactly, as in a
uniform permutation: the matrix of blocks and shards has the blocks' sizes and the shards' sizes as its sums. It is drawn in two
levels, first for groups of blocks on the driver and then for a group's blocks in one task each, which gives
the same law. Then a block's rows are permuted and dealt by its line of the matrix, exchanged, and permuted
again inside their shards, where a second random key places them.

The random orders come from keyed hashes of each row's place in a stored copy of the input, so tasks that run again agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import checkpoint, stored
from gridloom.operators.loaders import places

#: Rows of a block as a power of two, and blocks of a group: a group, one row on the driver, stands for up to 2 ** 26 rows.
BLOCK_BITS, GROUP = 16, 1024
#: Numpy's own draws end here.
NUMPY_MOST = 10**9
#: Bits of the random key that deal rows to the runs of a shard.
KEY_BITS = 40


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without replacement are good.

    Beyond numpy's limit by inversion: the chances around the mode, up to 14 standard deviations on either side, come from
    the exact ratios of neighbours, so there is no limit on the counts.
    """
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    least, most = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), least), most)
    spread = int(14 * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5) + 30
    k = np.arange(max(least, mode - spread), min(most, mode + spread) + 1)
    step = np.log((good - k[:-1]) * ((n - k[:-1]) / (k[1:] * (bad - n + k[1:]).astype(np.float64))))
    weight = np.concatenate(([0.0], np.cumsum(step)))
    upto = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(upto, rng.random() * upto[-1], "right")])


def deal(rng: np.random.Generator, room: list[int], n: int) -> list[int]:
    """How many of ``n`` rows each shard gets, where ``room`` places are left in them."""
    rest, out = sum(room), []
    for places_left in room:
        rest -= places_left
        got = hypergeometric(rng, places_left, rest, n) if n else 0
        out.append(got)
        n -= got
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes of the shards, at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _matrix(rows: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """(block, upto): the running sums of each block's line of the matrix; and the number of all rows."""
    spark = rows.sparkSession
    sizes = checkpoint(rows.groupBy("block").agg(F.count("*").alias("n")))
    groups = max(1, -(-sizes.count() // GROUP))
    sizes = sizes.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
    totals = sizes.groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect()
    count = sum(t["n"] for t in totals)
    rng, room, lines = np.random.default_rng([seed, 0]), shard_sizes(count, shards), []
    for t in totals:
        got = deal(rng, room, t["n"])
        room = [a - b for a, b in zip(room, got, strict=True)]
        lines.append((t["g"], got))

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        own, left, out = np.random.default_rng([seed, 1, table["g"][0].as_py()]), table["room"][0].as_py(), []
        for n in table["n"].to_pylist():
            got = deal(own, left, n)
            left = [a - b for a, b in zip(left, got, strict=True)]
            out.append(np.cumsum(got))
        return pa.table({"block": table["block"], "upto": pa.array(out, pa.list_(pa.int64()))})

    rooms = spark.createDataFrame(lines, "g bigint, room array<bigint>")
    return sizes.join(rooms, "g").groupBy("g").applyInArrow(draw, "block bigint, upto array<bigint>"), count


def place_rows(docs: DataFrame, shards: int = 24, seed: int = 0, block_bits: int = BLOCK_BITS) -> DataFrame:
    """All rows with ``shard`` (from 0) and ``slot`` (from 0 without gaps inside it), a uniform shuffle; shards' sizes are at most one apart.

    Rows count by themselves: null and repeated ids, null, empty and very long texts and whole repeated rows
    each take one slot, wherever their copies go. Columns of ``docs`` named shard or slot are replaced. No rows give no rows.
    Reruns over the same partitions of the input agree. Rows move with all their columns, twice.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = stored(docs.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("at")))
    rows = rows.withColumn("block", F.shiftright("at", block_bits))
    matrix, count = _matrix(rows, shards, seed)
    # A block's rows in a random order, dealt by the running sums of its line.
    order = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "at"), "at")
    dealt = rows.withColumn("r", F.row_number().over(order) - 1).join(matrix, "block")
    dealt = stored(dealt.select("row", "at", F.size(F.filter("upto", lambda x: x <= F.col("r"))).alias("shard")))
    # The shard's rows in a second random order; runs of the key are of bounded size.
    runs = max(1, -(-count // (shards << block_bits)))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "at"), 64 - KEY_BITS)
    placed = places(dealt.withColumn("key", key), ["shard"], F.shiftright(F.col("key") * runs, KEY_BITS), ["key", "at"], "slot")
    return placed.select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """The shuffled rows as a Parquet folder a shard, each in files of consecutive slots; a shard of any size spreads over tasks."""
    placed = place_rows(docs, shards, **options).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(path)

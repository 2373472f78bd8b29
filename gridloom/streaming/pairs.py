"""Pairs of halves that arrive in any order on a stream, one half held as keyed state until its partner comes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state needs named variables, which this provider keeps.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pairing(StatefulProcessor):
    """Holds a key's first half, gives the pair when the other kind comes, and remembers that it came.

    The payload leaves the state with the pair; what stays of a key is a mark, by which later copies of a half are known.
    """

    def __init__(self, keys: list[str], kinds: tuple[str, str], repeated: str):
        self.kinds, self.repeated, self.pair = kinds, repeated, Row(*keys, *kinds)

    def init(self, handle) -> None:
        self.half = handle.getValueState("half", "kind string, payload binary")
        self.done = handle.getValueState("done", "pairs int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = half = tuple(self.half.get()) if self.half.exists() else None
        paired = done = self.done.exists()
        for row in rows:
            if row.kind not in self.kinds:
                raise ValueError(f"{key}: {row.kind} is no half of a pair")
            if not row.payload:
                raise ValueError(f"{key}: {row.kind} is empty")
            if paired or (half is not None and half[0] == row.kind):
                if self.repeated == "error":
                    raise ValueError(f"{key}: {row.kind} comes twice")
                continue
            if half is None:
                half = (row.kind, bytes(row.payload))
                continue
            both = {half[0]: half[1], row.kind: bytes(row.payload)}
            half, paired = None, True
            yield self.pair(*key, *(both[k] for k in self.kinds))
        if half != before:
            self.half.clear() if half is None else self.half.update(half)
        if paired and not done:
            self.done.update((1,))

    def close(self) -> None:
        pass


def paired_stream(members: DataFrame, keys: list[str], kinds: tuple[str, str] = ("jpg", "json"), repeated: str = "skip") -> DataFrame:
    """(keys, one column a kind) of a stream of (keys, kind, payload), each pair when its second half has come.

    A further copy of a half is left out, or an error with ``repeated="error"``; an empty payload or another kind is an error. State is
    spread by key; what it holds of unfinished pairs is one half each, on the executors' disks.
    """
    if repeated not in ("skip", "error"):
        raise ValueError("repeated is skip or error")
    key_types = ", ".join(f"`{c}` {members.schema[c].dataType.simpleString()}" for c in keys)
    rows = members.select(*keys, "kind", F.col("payload").cast("binary").alias("payload"))
    out = f"{key_types}, " + ", ".join(f"`{k}` binary" for k in kinds)
    return rows.groupBy(*keys).transformWithState(statefulProcessor=Pairing(keys, kinds, repeated), outputStructType=out, outputMode="Append", timeMode="None")


def halves_left(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(keys, kind, bytes) of the halves that the state holds after a micro-batch, by default the last one."""
    reader = spark.read.format("statestore").option("stateVarName", "half")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).select("key.*", F.col("value.kind").alias("kind"), F.length("value.payload").alias("bytes"))


def write_pairs(members: DataFrame, out: str, checkpoint: str, keys: list[str], complete: bool = False, **options) -> dict[str, int]:
    """Pair what is there of a stream, append the pairs to the Parquet folder ``out`` and stop; a later call goes on from the checkpoint.

    Returns the number of micro-batches, of halves left and the most that the state held after one of them. With ``complete`` halves
    that are left are an error, as at the end of an archive; the pairs are written all the same.
    """
    spark = members.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        query = paired_stream(members, keys, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batches = sorted({p["batchId"] for p in query.recentProgress if p["stateOperators"]})
    held = [halves_left(spark, checkpoint, b).count() for b in batches]
    left = halves_left(spark, checkpoint)
    report = {"batches": len(batches), "left": held[-1] if held else left.count(), "most_held": max(held, default=0)}
    if complete and report["left"]:
        some = ", ".join(str(tuple(r[k] for k in keys)) for r in left.select(*keys).orderBy(*keys).limit(5).collect())
        raise ValueError(f"{report['left']} halves without a partner: {some}")
    return report

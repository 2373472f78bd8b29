"""Propagation of soft labels from frame to frame, for all sequences at once.

A frame's labels are votes of the first frame and of the last few frames before it. Which pixels vote, and how much, depends on
features alone, so all frames' affinities are computed in one pass before any label is known. What is left to
iterate is light: frame after frame, weights meet the soft labels of the frames in the queue.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import fresh_folder

#: Digits to which affinities count as equal, so that ties do not hang on the order of a sum.
DIGITS = 9


def _tile_votes(reach: int, topk: int, temperature: float):
    """A task's votes: the targets of a tile of one frame against the context pixels around it, by matrix products."""

    def run(targets: pa.Table, sources: pa.Table) -> pa.Table:
        n, m = targets.num_rows, sources.num_rows
        if not n or not m:
            return pa.table({"sequence": pa.array([], pa.int64()), "frame": pa.array([], pa.int64()), "r": pa.array([], pa.int32()), "c": pa.array([], pa.int32()), "votes": pa.array([], _VOTES)})
        unit = lambda t, name: _unit(t[name].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
        x, y = unit(targets, "v"), unit(sources, "sv")
        r, c, sr, sc, frame = (t[k].to_numpy() for t, k in ((targets, "r"), (targets, "c"), (sources, "sr"), (sources, "sc"), (sources, "sframe")))
        # Rows of the context in their own order, so that equal votes add up in the same order in every run.
        order = np.lexsort((sc, sr, frame))
        y, sr, sc, frame = y[order], sr[order], sc[order], frame[order]
        many, at, weights = [], [], []
        for i in range(0, n, 256):
            sims = np.round(x[i : i + 256] @ y.T, DIGITS)
            near = (np.abs(r[i : i + 256, None] - sr[None]) <= reach) & (np.abs(c[i : i + 256, None] - sc[None]) <= reach)
            sims[~near] = -np.inf
            # All that are as near as the k-th vote; fewer neighbours than that all do.
            kth = np.partition(sims, m - topk, axis=1)[:, m - topk] if m > topk else np.full(len(sims), -np.inf)
            row, column = np.nonzero(near & (sims >= kth[:, None]))
            w = np.exp(sims[row, column] / temperature)
            w /= np.bincount(row, w, len(sims))[row]
            many.append(np.bincount(row, minlength=len(sims))), at.append(column), weights.append(w)
        at, offsets = np.concatenate(at), np.concatenate(([0], np.cumsum(np.concatenate(many))))
        chosen = pa.StructArray.from_arrays([pa.array(frame[at], pa.int64()), pa.array(sr[at], pa.int32()), pa.array(sc[at], pa.int32()), pa.array(np.concatenate(weights))], fields=list(_VOTES.value_type))
        votes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), chosen)
        return pa.table({"sequence": targets["sequence"], "frame": targets["frame"], "r": targets["r"], "c": targets["c"], "votes": votes})

    return run


_VOTES = pa.list_(pa.struct([("frame", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), ("w", pa.float64())]))
_VOTES_DDL = "sequence bigint, frame bigint, r int, c int, votes array<struct<frame: bigint, r: int, c: int, w: double>>"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)


def context_votes(features: DataFrame, queue: int = 7, reach: int = 12, topk: int = 5, temperature: float = 0.1, tile: int | None = None) -> DataFrame:
    """(sequence, frame, r, c, votes): for every pixel after frame 0 the context pixels that vote for it and their weights, which add up to 1.

    ``features``: (sequence, frame, r, c, v) with frames 0, 1, 2 and so on. The context of frame t is frame 0 and the ``queue`` frames before
    t; frame 0 is no member of the queue. Pixels within ``reach`` rows and columns vote, the ``topk`` most alike and all ties
    of the last. Targets are cut into square tiles of ``tile`` pixels, and a source is sent to those tiles whose neighbourhood
    holds it, so a task has one tile and at most (queue + 1) * (tile + 2 * reach) ** 2 sources, whatever the size of a frame.
    """
    if min(queue, reach, topk) < 1 or temperature <= 0:
        raise ValueError("queue, reach, topk and temperature must be positive")
    tile = tile or max(8, 2 * reach)
    cell = lambda x: F.floor(x / tile)
    rows = features.select(F.col("sequence").cast("bigint"), F.col("frame").cast("bigint"), F.col("r").cast("int"), F.col("c").cast("int"), F.col("v").cast("array<double>").alias("v"))
    targets = rows.where("frame > 0").withColumn("tr", cell(F.col("r"))).withColumn("tc", cell(F.col("c"))).withColumn("t", F.col("frame"))
    # A frame serves the frames after it, frame 0 all of them; the last frame bounds both.
    last = rows.groupBy(F.col("sequence").alias("ofs")).agg(F.max("frame").alias("last"))
    sources = rows.join(last, F.col("sequence") == F.col("ofs"))
    until = F.when(F.col("frame") == 0, F.col("last")).otherwise(F.least(F.col("last"), F.col("frame") + queue))
    sources = sources.where(F.col("frame") < F.col("last")).withColumn("st", F.explode(F.sequence(F.col("frame") + 1, until)))
    tiles = lambda x: F.explode(F.sequence(cell(F.col(x) - reach), cell(F.col(x) + reach)))
    sources = sources.select(F.col("sequence").alias("ss"), "st", F.col("frame").alias("sframe"), F.col("r").alias("sr"), F.col("c").alias("sc"), F.col("v").alias("sv"), tiles("r").alias("str")).withColumn("stc", tiles("sc"))
    return targets.groupBy("sequence", "t", "tr", "tc").cogroup(sources.groupBy("ss", "st", "str", "stc")).applyInArrow(_tile_votes(reach, topk, temperature), _VOTES_DDL)


def weighted_sum(rows: Column, size: Column) -> Column:
    """The sum of w * soft over an array of structs of both, in the array's order."""
    zeros = F.array_repeat(F.lit(0.0), size.cast("int"))
    return F.aggregate(rows, zeros, lambda s, x: F.zip_with(s, x["soft"], lambda a, b: a + x["w"] * b))


def propagate(features: DataFrame, first: DataFrame, queue: int = 7, reach: int = 12, topk: int = 5, temperature: float = 0.1, folder: str | None = None) -> DataFrame:
    """(sequence, frame, r, c, soft): soft labels of all frames, those of frame 0 as given.

    ``features``: (sequence, frame, r, c, v); ``first``: (sequence, r, c, soft), an array of a share for each class. Frame t is the
    weighted mean of the soft labels of its context, and goes back into the queue as it is, not as its greatest class.
    Every frame is one table of ``folder`` once it is made (by default a folder that ends with the driver), so a
    frame reads the tables of its queue alone: the state never holds more than ``queue`` + 1 frames, the
    oldest leaves as a new one comes, and a lost executor repeats no more than one frame. A run over a folder that holds
    frames already goes on after the last whole one. A pixel of which no context pixel is near gets no row.
    """
    spark = features.sparkSession
    folder = folder or fresh_folder(spark, "propagated")
    place = lambda t: f"{folder}/soft/frame={t}"
    if not _whole(spark, f"{folder}/votes"):
        votes = context_votes(features, queue, reach, topk, temperature)
        votes.repartitionByRange("frame", "sequence", "r", "c").write.mode("overwrite").partitionBy("frame").parquet(f"{folder}/votes")
    if not _whole(spark, place(0)):
        first.select(F.col("sequence").cast("bigint"), F.col("r").cast("int"), F.col("c").cast("int"), F.col("soft").cast("array<double>").alias("soft")).write.mode("overwrite").parquet(place(0))
    frames = features.agg(F.max("frame")).first()[0] or 0
    state = "sequence bigint, r int, c int, soft array<double>"
    for t in range(1, frames + 1):
        if _whole(spark, place(t)):
            continue
        held = [0, *range(max(1, t - queue), t)]
        context = None
        for s in held:
            one = spark.read.schema(state).parquet(place(s)).select(F.col("sequence").alias("ss"), F.lit(s).cast("bigint").alias("sf"), F.col("r").alias("sr"), F.col("c").alias("sc"), "soft")
            context = one if context is None else context.unionByName(one)
        asked = spark.read.parquet(f"{folder}/votes").where(F.col("frame") == t).select("sequence", "r", "c", F.explode("votes").alias("x"))
        on = (F.col("sequence") == F.col("ss")) & (F.col("x.frame") == F.col("sf")) & (F.col("x.r") == F.col("sr")) & (F.col("x.c") == F.col("sc"))
        met = asked.join(context, on).select("sequence", "r", "c", F.struct("sf", "sr", "sc", F.col("x.w").alias("w"), "soft").alias("x"))
        voted = met.groupBy("sequence", "r", "c").agg(F.array_sort(F.collect_list("x")).alias("x"))
        voted.select("sequence", "r", "c", weighted_sum(F.col("x"), F.size(F.col("x")[0]["soft"])).alias("soft")).write.mode("overwrite").parquet(place(t))
    return spark.read.schema(state + ", frame bigint").parquet(f"{folder}/soft").select("sequence", "frame", "r", "c", "soft")


def _whole(spark, path: str) -> bool:
    """Whether a table was written to its end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def hard_labels(soft: DataFrame) -> DataFrame:
    """(sequence, frame, r, c, label, share): each class of a frame is stretched from its least to its greatest share, then the greatest wins, the first of equals.

    A class that a frame does not hold stays at 0.
    """
    long = soft.select("sequence", "frame", "r", "c", F.posexplode("soft").alias("class", "x"))
    span = long.groupBy("sequence", "frame", "class").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    span = span.select(F.col("sequence").alias("s2"), F.col("frame").alias("f2"), F.col("class").alias("k2"), "low", "high")
    met = long.join(span, (F.col("sequence") == F.col("s2")) & (F.col("frame") == F.col("f2")) & (F.col("class") == F.col("k2")))
    stretched = F.when(F.col("high") > F.col("low"), (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    best = met.withColumn("s", F.round(stretched, DIGITS)).groupBy("sequence", "frame", "r", "c").agg(F.min(F.struct((-F.col("s")).alias("s"), "class", "x")).alias("b"))
    return best.select("sequence", "frame", "r", "c", F.col("b.class").cast("int").alias("label"), F.col("b.x").alias("share"))


def queue_of(frames: DataFrame, queue: int) -> DataFrame:
    """(sequence, frame, context): for each frame after 0 of (sequence, frame) the frames that vote for it, in order."""
    before = F.collect_list(F.when(F.col("frame") > 0, F.col("frame"))).over(W.partitionBy("sequence").orderBy("frame").rangeBetween(-queue, -1))
    zero = F.array(F.lit(0).cast(frames.schema["frame"].dataType))
    return frames.withColumn("context", F.concat(zero, before)).where("frame > 0")

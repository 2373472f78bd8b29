"""Exact nearest neighbours around pivots: cells of the context are left out where the triangle inequality allows.

Every context row belongs to the cell of its nearest pivot. A target first meets the nearest cells that together
hold k rows, which bounds the distance of its k-th neighbour. Then it meets only those other cells that can hold a row within
that distance: by the cell's least and greatest distance from its pivot, and by the planes half way between pivots. Large
cells are cut into blocks, and so are the targets that ask for one cell, so a task has a bounded number of both. It compares
them by tiles of TILE pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import stored

#: Digits to which similarities count as equal; what bounds are widened by, for that and for rounding.
DIGITS, SLACK = 9, 1e-6
#: Pivots at the most, numbers in all pivots at the most, rows of a block of a cell, targets of a block.
PIVOTS, PIVOT_CELLS, BLOCK, TARGETS = 4096, 1 << 21, 8192, 65_536
#: Pairs of rows, or of rows and pivots, that a task compares at once; a bound on memory only.
TILE = 1 << 20


class Cells:
    """Pivots by rows, and how many context rows each one's cell holds, at what least and greatest distance."""

    def __init__(self, pivots: np.ndarray, count: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.pivots, self.count, self.least, self.most = pivots, count, least, most
        self.between = distances(pivots, pivots) if len(pivots) else np.zeros((0, 0))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T, 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that make TILE pairs at the most with ``width`` others."""
    step = max(1, TILE // max(1, width))
    return (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step))


def _lists(mask: np.ndarray) -> pa.Array:
    """The marked columns of each row."""
    offsets = np.concatenate(([0], np.cumsum(mask.sum(axis=1))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.nonzero(mask)[1], pa.int32()))


def pivot_cells(context: DataFrame, pivots: int | None = None) -> tuple[DataFrame, Cells]:
    """The context (id, v, label) with each row's cell, stored, and the cells.

    Pivots are rows in the order of a hash of their ids, about half the root of their number and at most PIVOTS.
    """
    n = context.count()
    wanted = pivots or max(1, min(PIVOTS, int(n**0.5 / 2)))
    chosen = np.asarray([r["v"] for r in context.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()], np.float64)
    if len(chosen):
        chosen = np.unique(chosen[: max(1, PIVOT_CELLS // chosen.shape[1])], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _tiles(batches, len(chosen)):
            far = distances(_matrix(batch.column(1)), chosen)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])], names=["id", "v", "label", "cell", "far"])

    kind = {c: context.schema[c].dataType.simpleString() for c in ("id", "label")}
    rows = stored(context.select("id", "v", "label").mapInArrow(run, f"id {kind['id']}, v array<double>, label {kind['label']}, cell int, far double"))
    count, least, most = np.zeros(len(chosen), np.int64), np.zeros(len(chosen)), np.zeros(len(chosen))
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect():
        count[r["cell"]], least[r["cell"]], most[r["cell"]] = r["n"], r["least"], r["most"]
    return rows, Cells(chosen, count, least, most)


def _asked(targets: DataFrame, cells: Cells, k: int, second: bool) -> DataFrame:
    """(id, v, floor, cells): the nearest cells that hold k rows, or all others that can hold one as near as the k-th found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _tiles(batches, len(cells.pivots)):
            far = distances(_matrix(batch.column(1)), cells.pivots)
            order = np.argsort(far, axis=1, kind="stable")
            held = np.cumsum(cells.count[order], axis=1)
            # The first cells up to the one with which k rows are reached.
            first = np.zeros(far.shape, bool)
            np.put_along_axis(first, order, held - cells.count[order] < k, axis=1)
            mask = first
            if second:
                floor = batch.column(2).to_numpy(zero_copy_only=False)
                reach = np.sqrt(np.maximum(2 - 2 * floor, 0.0))[:, None] + SLACK
                nearest = order[:, 0]
                apart = cells.between[nearest]
                plane = np.divide(far**2 - far[np.arange(len(far)), nearest][:, None] ** 2, 2 * apart, out=np.zeros_like(far), where=apart > SLACK)
                bound = np.maximum(np.maximum(far - cells.most, cells.least - far), plane)
                mask = ~first & (bound <= reach) & (cells.count > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(mask)], names=["id", "v", "floor", "cells"])

    kind = targets.schema["id"].dataType.simpleString()
    return stored(targets.mapInArrow(run, f"id {kind}, v array<double>, floor double, cells array<int>").where("size(cells) > 0"))


def _hits(x: np.ndarray, y: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of each row's k best of at least its floor, with ties; rounded only where that can count."""
    s, least, near = x @ y.T, floor.copy(), 10.0**-DIGITS
    hit = s >= (least - near)[:, None]
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
    if len(many):
        own = s[many]
        least[many] = np.maximum(least[many], np.round(np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k], DIGITS))
        hit[many] = own >= (least[many] - near)[:, None]
    a, b = np.nonzero(hit)
    sim = np.round(s[a, b], DIGITS)
    held = sim >= least[a]
    return a[held], b[held], sim[held]


def _best(k: int):
    def run(t: pa.Table, c: pa.Table) -> pa.Table:
        if not t.num_rows or not c.num_rows:
            return pa.table({"t": t["id"][:0], "near": c["cid"][:0], "label": c["label"][:0], "sim": pa.array([], pa.float64())})
        y, floor = _matrix(c["cv"].combine_chunks()), np.round(t["floor"].to_numpy(zero_copy_only=False), DIGITS)
        rows, cols, sims, done = [], [], [], 0
        for tile in _tiles(t.select(["v"]).to_batches(), len(y)):
            a, b, sim = _hits(_matrix(tile.column(0)), y, floor[done : done + tile.num_rows], k)
            rows.append(a + done), cols.append(b), sims.append(sim)
            done += tile.num_rows
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        return pa.table({"t": t["id"].combine_chunks().take(pa.array(rows)), "near": c["cid"].combine_chunks().take(pa.array(cols)), "label": c["label"].combine_chunks().take(pa.array(cols)), "sim": np.concatenate(sims)})

    return run


def _met(asked: DataFrame, rows: DataFrame, cells: Cells, k: int) -> tuple[DataFrame, int]:
    """(t, near, label, sim) of each target's best in each block of the cells it asks for, and the number of pairs compared."""
    wanted = {r["cell"]: r["n"] for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    pairs = sum(n * int(cells.count[c]) for c, n in wanted.items())
    cuts = [(c, -(-int(cells.count[c]) // BLOCK), -(-n // TARGETS)) for c, n in wanted.items()]
    # One row a pivot.
    table = F.broadcast(asked.sparkSession.createDataFrame(cuts, "cut int, blocks int, turns int"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.select("id", "v", "floor", F.explode("cells").alias("cell")).join(table, F.col("cell") == F.col("cut"))
    left = left.select("id", "v", "floor", "cell", every("blocks").alias("block"), dealt("id", F.col("turns")).alias("turn"))
    right = rows.join(table, F.col("cell") == F.col("cut")).select(F.col("id").alias("cid"), F.col("v").alias("cv"), "label", F.col("cell").alias("ccell"), dealt("id", F.col("blocks")).alias("cblock"), every("turns").alias("cturn"))
    out = _result(asked, rows)
    return left.groupBy("cell", "block", "turn").cogroup(right.groupBy("ccell", "cblock", "cturn")).applyInArrow(_best(k), out), pairs


def _top(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("_r", F.rank().over(W.partitionBy("t").orderBy(F.desc("sim"))))
    return ranked.where(F.col("_r") <= k).drop("_r")


def _result(ids: DataFrame, context: DataFrame) -> str:
    kind = {"t": ids.schema["id"], "near": context.schema["id"], "label": context.schema["label"]}
    return ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in kind.items()) + ", sim double"


def _whole(targets: DataFrame, context: DataFrame, k: int) -> DataFrame:
    """The best of a context of one block for blocks of targets."""
    turns = max(1, -(-targets.count() // TARGETS))
    left = targets.select("id", F.col("v").cast("array<double>").alias("v"), F.lit(-2.0).alias("floor"), F.pmod(F.xxhash64("id"), F.lit(turns)).alias("turn"))
    right = context.select(F.col("id").alias("cid"), F.col("v").cast("array<double>").alias("cv"), F.col("label").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("cturn"))
    return left.groupBy("turn").cogroup(right.groupBy("cturn")).applyInArrow(_best(k), _result(targets, context))


def nearest(targets: DataFrame, context: DataFrame, k: int, pivots: int | None = None) -> tuple[DataFrame, float]:
    """(t, near, label, sim): each target's k most similar context rows with all ties of the last; and the share of all pairs that was compared.

    Both sides have (id, v), v an array of doubles of unit length; the context also has a label. Every target's result is that of
    comparing it with all rows. Fewer than k context rows all come; none give no rows. A context of one block needs no cells,
    unless ``pivots`` says how many.
    """
    n = context.count()
    if pivots is None and 0 < n <= BLOCK:
        return _top(_whole(targets, context, k), k), 1.0
    rows, cells = pivot_cells(context, pivots)
    plain = targets.select("id", F.col("v").cast("array<double>").alias("v"), F.lit(-2.0).alias("floor"))
    if not len(cells.pivots):
        return targets.sparkSession.createDataFrame([], _result(targets, rows)), 0.0
    asked = _asked(plain, cells, k, False)
    found, one = _met(asked, rows, cells, k)
    first = stored(_top(found, k))
    # The k-th similarity so far; with fewer than k rows found there are no others.
    floors = first.groupBy(F.col("t").alias("of")).agg(F.min("sim").alias("least"))
    bounded = asked.select("id", "v").join(floors, F.col("id") == F.col("of")).select("id", "v", F.col("least").alias("floor"))
    more, two = _met(_asked(bounded, cells, k, True), rows, cells, k)
    n = asked.count()
    return _top(first.unionByName(more), k), (one + two) / max(1, n * int(cells.count.sum()))

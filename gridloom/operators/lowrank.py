"""The first principal components of wide rows by a randomised range finder; no d x d matrix is ever made.

A subspace of k + spare directions is started at random and improved by power rounds, each one pass over the rows, in
which a task sends d * (k + spare) sums and no more. Then the rows are projected on it, and the tall, narrow result is
reduced by QR: every task reduces its rows to one small triangle, triangles are reduced in groups, and a last
decomposition of a small matrix gives the components and their variances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Triangles that one task reduces.
FAN = 64


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Each batch's vectors as a matrix; null vectors are left out, several widths are an error."""
    for batch in batches:
        column = batch.column(0).drop_null()
        if not len(column):
            continue
        widths = np.diff(column.offsets.to_numpy())
        if (widths != widths[0]).any():
            raise ValueError("vectors of several widths")
        yield column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _summed(rows: DataFrame, part) -> np.ndarray | None:
    """The sum over all rows of ``part(matrix)``, an array of any shape: one row a task, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _batches(batches):
            own = part(x)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["x"])

    cells = rows.mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    found = cells.toArrow()
    if not found.num_rows:
        return None
    out = np.empty(found.num_rows)
    out[found["i"].to_numpy()] = found["x"].to_numpy()
    return out


def tall_qr(rows: DataFrame, project) -> np.ndarray:
    """The triangle R of the QR decomposition of ``project(matrix)`` over all rows, by a tree of small ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for x in _batches(batches):
            y = project(x)
            r = np.linalg.qr(y if r is None else np.vstack((r, y)), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64())), pa.array([r.shape[1]], pa.int32())], names=["part", "r", "w"])

    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        width = table["w"][0].as_py()
        r = np.linalg.qr(np.vstack([x.values.to_numpy().reshape(-1, width) for x in table["r"]]), mode="r")
        return pa.table({"part": table["part"][:1], "r": pa.array([r.ravel()], pa.list_(pa.float64())), "w": table["w"][:1]})

    schema = "part int, r array<double>, w int"
    triangles = rows.mapInArrow(run, schema).groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(reduce, schema).toArrow().sort_by("part")
    width = triangles["w"][0].as_py()
    return np.linalg.qr(np.vstack([x.values.to_numpy().reshape(-1, width) for x in triangles["r"]]), mode="r")


class Components:
    """A fit: the mean, the components by rows, and the rows' variances along them (over n)."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, variances: np.ndarray, rows: int, rounds: int):
        self.mean, self.components, self.variances, self.rows, self.rounds = mean, components, variances, rows, rounds


def low_rank_components(rows: DataFrame, vector: str, k: int, spare: int = 16, rounds: int = 200, tolerance: float = 1e-10, max_samples: int | None = None, seed: int = 0) -> Components:
    """The first ``k`` components of array rows.

    Power rounds end when the first ``k`` variances change by less than ``tolerance`` of the first one, or after ``rounds``. With ``max_samples``
    the fit sees about so many rows, chosen by a hash of the vector (all of them if there are fewer); equal vectors are
    chosen or left together. Null vectors are left out; fewer than two rows, or a width below ``k``, are an error. What
    reaches the driver is d * (k + spare) numbers a round.
    """
    x = rows.select(F.col(vector).cast("array<double>").alias("x")).where("x is not null")
    if max_samples is not None:
        share = max_samples / max(1, x.count())
        if share < 1:
            x = x.where(F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(1 << 30)) < int(share * (1 << 30)))
    first = _summed(x, lambda m: np.concatenate(([len(m)], m.sum(axis=0))))
    if first is None or first[0] < 2:
        raise ValueError("components need two rows")
    n, mean = int(first[0]), first[1:] / first[0]
    d = len(mean)
    if not 0 < k <= d:
        raise ValueError(f"{k} components of vectors of {d}")
    wide = min(d, k + spare)
    q, before, done = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, wide)))[0], None, 0
    for done in range(1, rounds + 1):
        z = _summed(x, lambda m, q=q: (m - mean).T @ ((m - mean) @ q)).reshape(d, wide)
        now = np.sort(np.linalg.eigvalsh((q.T @ z + z.T @ q) / 2))[::-1][:k]
        q = np.linalg.qr(z)[0]
        if wide == d or (before is not None and np.abs(now - before).max() <= tolerance * max(now[0], 1e-300)):
            break
        before = now
    r = tall_qr(x, lambda m: (m - mean) @ q)
    _, s, vt = np.linalg.svd(r)
    # Each component's largest part is positive, so that runs agree.
    components = vt[:k] @ q.T
    components *= np.sign(components[np.arange(k), np.abs(components).argmax(axis=1)])[:, None]
    variances = np.zeros(k)
    variances[: min(k, len(s))] = (s[:k] ** 2 / n)[: min(k, len(s))]
    return Components(mean, components, variances, n, done)


def project(rows: DataFrame, vector: str, fit: Components, name: str = "projected") -> DataFrame:
    """All rows with their coordinates along the components, as an array by matrix products of Arrow batches; null vectors give null."""
    mean, basis = fit.mean, fit.components.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index("_v"))
            there = ~column.is_null().to_numpy(zero_copy_only=False)
            out: list = [None] * batch.num_rows
            flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
            for i, y in zip(np.flatnonzero(there).tolist(), (flat.reshape(int(there.sum()), -1) - mean) @ basis if there.any() else [], strict=True):
                out[i] = y
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["_row", "_y"])

    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(vector).cast("array<double>").alias("_v"))
    made = whole.mapInArrow(run, f"_row {whole.schema['_row'].dataType.simpleString()}, _y array<double>")
    return made.select("_row.*", F.col("_y").alias(name))


def display_scaled(rows: DataFrame, name: str) -> DataFrame:
    """An array column with every place scaled to 0 at its least and 1 at its greatest over all rows; a constant place becomes 0."""
    long = rows.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    # One row of k bounds, which is the fit's width and not the data's size.
    bounds = long.agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("_b"))
    scaled = F.zip_with(name, "_b", lambda x, b: F.when(b["high"] > b["low"], (x - b["low"]) / (b["high"] - b["low"])).otherwise(0.0))
    return rows.crossJoin(F.broadcast(bounds)).withColumn(name, scaled).drop("_b")

"""Vector analytics on (id, array) rows: normalisation, projection, affinity, pulls and averages."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.vectors import dot, norm


def exploded(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, d, x): one row a component, d from 0."""
    return rows.select(*keys, F.posexplode(vector).alias("d", "x"))


def layer_norm(v: Column, eps: float = 1e-6) -> Column:
    """(x - mean) / sqrt(var_pop + eps) over an array."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean
    return F.transform(v, lambda x: (x - mean) / F.sqrt(var + eps))


def minmax_scale(long: DataFrame, dimension: str = "d", value: str = "x", floor: float = 1e-4) -> DataFrame:
    """Adds ``scaled``: (x - min) / max(range, floor) - 0.5 by dimension over all rows; ranges join back, one row a dimension."""
    ranges = long.groupBy(dimension).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(floor)) - 0.5
    return long.join(ranges, dimension).withColumn("scaled", scaled).drop("_lo", "_hi")


def group_mean_pull(long: DataFrame, group: str, alpha: float = 0.8) -> DataFrame:
    """Adds ``pulled``: (1 - alpha) * x + alpha * mean of the group's dimension, for disjoint groups.

    Means are pre-aggregated and joined, so a hot group is not gathered in one task.
    """
    means = long.groupBy(group, "d").agg(F.avg("x").alias("_m"))
    return long.join(means, [group, "d"]).withColumn("pulled", (1 - alpha) * F.col("x") + alpha * F.col("_m")).drop("_m")


def sequential_pull(rows: DataFrame, members: DataFrame, alpha: float = 0.8) -> DataFrame:
    """The pull by overlapping masks in order: (image, pixel, v) after masks (image, mask, pixel).

    Pixels of the same masks move alike: each ends as a share of itself plus a vector that they have in common. So
    pixels are summed up by their set of masks, the masks are folded over these sums, and the outcome is joined back; a
    task holds the sums of an image and never its pixels. Repeated members count once.
    """
    sets = members.groupBy("image", "pixel").agg(F.sort_array(F.collect_set("mask")).alias("_set"))
    none = F.array().cast(sets.schema["_set"].dataType)
    marked = rows.select("image", "pixel", F.col("v").cast("array<double>").alias("v")).join(sets, ["image", "pixel"], "left").withColumn("_set", F.coalesce("_set", none))
    means = marked.select("image", "_set", F.posexplode("v").alias("d", "x")).groupBy("image", "_set", "d").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = means.where("size(_set) > 0").groupBy("image", "_set").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("sum"))

    def fold(table: pa.Table) -> pa.Table:
        own, n = table["_set"].to_pylist(), table["n"].to_numpy().astype(np.float64)
        total = np.asarray(table["sum"].to_pylist(), np.float64)
        share, moved = np.ones(len(own)), np.zeros(total.shape)
        for mask in sorted({m for s in own for m in s}):
            at = [k for k, s in enumerate(own) if mask in s]
            mean = (share[at, None] * total[at] + n[at, None] * moved[at]).sum(axis=0) / n[at].sum()
            share[at] *= 1 - alpha
            moved[at] = (1 - alpha) * moved[at] + alpha * mean
        sets_ = table["_set"].cast(pa.list_(table["_set"].type.value_type))
        return pa.table({"image": table["image"], "_set": sets_, "share": share, "moved": pa.array(list(moved), pa.list_(pa.float64()))})

    kind = sums.schema
    outcome = sums.groupBy("image").applyInArrow(fold, f"image {kind['image'].dataType.simpleString()}, _set {kind['_set'].dataType.simpleString()}, share double, moved array<double>")
    pulled = F.when(F.col("share").isNull(), F.col("v")).otherwise(F.zip_with("v", "moved", lambda x, m: F.col("share") * x + m))
    return marked.join(outcome, ["image", "_set"], "left").select(F.col("image").cast("bigint").alias("image"), F.col("pixel").cast("bigint").alias("pixel"), pulled.alias("v"))


def dispersion(long: DataFrame, group: str) -> DataFrame:
    """(group, dispersion): mean over components and rows of the squared deviation from the group's mean."""
    by = long.groupBy(group, "d").agg(F.var_pop("x").alias("v"))
    return by.groupBy(group).agg(F.avg("v").alias("dispersion"))


def fourier(positions: Column, n: int, low: float = -2.0, high: float = 10.0) -> Column:
    """sin and cos of a coordinate times exp(linspace(low, high, n)): an array of 2 n values."""
    steps = [math.exp(low + (high - low) * i / (n - 1)) for i in range(n)]
    return F.array(*[F.sin(positions * s) for s in steps], *[F.cos(positions * s) for s in steps])


def projection_matrix(rows: int, columns: int, seed: int = 1) -> list[list[float]]:
    """A fixed matrix of unit columns from a linear congruential sequence."""
    state, out = seed, []
    for _ in range(columns):
        column = []
        for _ in range(rows):
            state = (state * 1103515245 + 12345) % 2**31
            column.append(state / 2**31 - 0.5)
        length = math.sqrt(sum(x * x for x in column))
        out.append([x / length for x in column])
    return out


def project(v: Column, matrix: list[list[float]]) -> Column:
    """The vector times each column of a matrix, as an array."""
    return F.array(*[dot(v, F.array(*[F.lit(x) for x in column])) for column in matrix])


def second_moments(rows: DataFrame, left: str, right: str, group: str | None = None, held: int = 256) -> DataFrame:
    """(group, n, sums of left, cells): cells are the sums of left[i] * right[j], by rows, as one array.

    Each task adds up products of whole Arrow batches by matrix multiplication and sends one row a group (at most
    ``held`` groups at a time), so no row is exploded to its d * d products. Without ``group`` it is 0.
    """
    kind = rows.schema[group].dataType.simpleString() if group else "int"
    chosen = rows.select((F.col(group) if group else F.lit(0)).alias("g"), F.col(left).cast("array<double>").alias("a"), F.col(right).cast("array<double>").alias("b")).where("a is not null and b is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        key = pa.int32()

        def packed():
            out = list(sums.items())
            lists = lambda values: pa.array(values, pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], key), pa.array([s[0] for _, s in out], pa.int64()), lists([s[1] for _, s in out]), lists([s[2].ravel() for _, s in out])], names=["g", "n", "sums", "cells"])

        for batch in batches:
            key = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            x, y = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (1, 2))
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            # Rows sorted by group, cut where it changes.
            order = np.argsort(codes, kind="stable")
            ends = np.flatnonzero(np.diff(codes[order], append=-1)) + 1
            for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                g, p, q = names[codes[order[i]]], x[order[i:j]], y[order[i:j]]
                n, s, c = sums.get(g, (0, 0.0, 0.0))
                sums[g] = (n + len(p), s + p.sum(axis=0), c + p.T @ q)
            if len(sums) > held:
                yield packed()
                sums.clear()
        if sums:
            yield packed()

    parts = chosen.mapInArrow(run, f"g {kind}, n bigint, sums array<double>, cells array<double>")
    name = group or "g"
    # Count, sums and cells as one array, so that the products are made once.
    flat = parts.select(F.col("g").alias(name), F.size("sums").alias("_d"), F.posexplode(F.concat(F.array(F.col("n").cast("double")), "sums", "cells")).alias("i", "x"))
    added = flat.groupBy(name, "_d", "i").agg(F.sum("x").alias("x"))
    whole = added.groupBy(name, "_d").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return whole.select(name, F.get("v", F.lit(0)).cast("bigint").alias("n"), F.slice("v", F.lit(2), F.col("_d")).alias("sums"), F.slice("v", F.col("_d") + 2, F.size("v")).alias("cells"))


def affinity_gram(pairs: DataFrame, group: str, a: str, b: str, eps: float = 1e-6) -> DataFrame:
    """(group, mse): mean squared difference of the two cosine matrices of a group, by second moments.

    ||XX'||^2 + ||YY'||^2 - 2 ||XY'||^2 over n^2, with the moments summed before the shuffle; no pair of rows is formed.
    """
    unit = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: x / (norm(F.col(c)) + eps))
    rows = pairs.select(group, unit(a).alias("_a"), unit(b).alias("_b"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    both = rows.select(group, F.concat("_a", "_b").alias("_z"), F.size("_a").alias("_d"))
    m = second_moments(both, "_z", "_z", group)
    # Cells of [X Y]'[X Y]: the blocks XX, XY and YY by place, with the width of X from its size.
    width = both.groupBy(group).agg(F.max("_d").alias("_d"))
    cells = m.join(width, group).select(group, "n", "_d", F.sqrt(F.size("cells")).cast("int").alias("_w"), "cells")
    sign = lambda i: F.when((F.floor(i / F.col("_w")) < F.col("_d")) == (i % F.col("_w") < F.col("_d")), 1.0).otherwise(-1.0)
    total = F.aggregate(F.transform("cells", lambda x, i: sign(i) * x * x), F.lit(0.0), lambda s, x: s + x)
    return cells.select(group, F.greatest(total / (F.col("n") * F.col("n")), F.lit(0.0)).alias("mse"))


def principal_components(rows: DataFrame, vector: str, k: int):
    """(mean, components, variances) of array rows from d * d second moments; only those reach the driver."""
    first = second_moments(rows, vector, vector).collect()
    if not first:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    n, means = first[0]["n"], np.asarray(first[0]["sums"]) / first[0]["n"]
    cov = np.asarray(first[0]["cells"]).reshape(len(means), len(means)) / n - np.outer(means, means)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:k]
    return means, vectors[:, top].T, values[top]


def ema(rows: DataFrame, group: str, step: str, value: str, beta: float, every: int = 1, after: int = 0, block: int = 4096, bucket: Column | None = None) -> DataFrame:
    """(group, ema): an average that copies the first value and until ``after``, then every ``every`` steps moves by 1 - beta.

    A step is the map a -> p a + q: copying is (0, x), moving (beta, (1 - beta) x), resting (1, 0). Maps are composed inside
    blocks of ``block`` steps and then over the blocks of a group, so a long series spreads over tasks. ``bucket`` never falls
    along ``step`` and spreads the numbering of the steps.
    """
    from gridloom.operators.loaders import places

    numbered = places(rows.select(group, step, F.col(value).cast("double").alias("_x")), [group], bucket, [step, "_x"], "_i")
    pair = lambda p, q: F.struct(p.cast("double").alias("p"), q.cast("double").alias("q"))
    start = pair(F.lit(1.0), F.lit(0.0))

    def step_map(s: Column) -> Column:
        due = s["i"] % every == 0
        return F.when((s["i"] == 0) | ((s["i"] <= after) & due), pair(F.lit(0.0), s["x"])).when(due, pair(F.lit(beta), (1 - beta) * s["x"])).otherwise(start)

    then = lambda a, b: pair(a["p"] * b["p"], a["q"] * b["p"] + b["q"])
    blocks = numbered.groupBy(group, F.floor(F.col("_i") / block).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_x").alias("x")))).alias("_s"))
    maps = blocks.select(group, "_k", F.aggregate(F.transform("_s", step_map), start, then).alias("_m"))
    whole = maps.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda s: s["_m"]).alias("_all"))
    return whole.select(group, F.aggregate("_all", start, then)["q"].alias("ema"))

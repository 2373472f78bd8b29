"""Evaluation: confusion and mean IoU, region J, boundary F, sequence statistics, optimal assignment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n)."""
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_iou(counts: DataFrame) -> DataFrame:
    """(class, iou) from confusion counts: tp / (tp + fp + fn)."""
    right = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    t = counts.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("in_truth"), F.sum(right).alias("tp"))
    p = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("in_pred"))
    both = t.join(p, "class", "full_outer").na.fill(0)
    return both.select("class", (F.col("tp") / (F.col("in_truth") + F.col("in_pred") - F.col("tp"))).alias("iou"))


def region_j(pixels: DataFrame, keys: list[str], truth: str = "truth", predicted: str = "pred", void: str | None = None) -> DataFrame:
    """(keys, j): intersection over union, 1 for an empty union; void pixels count in neither."""
    rows = pixels if void is None else pixels.where(~F.col(void))
    both = F.sum((F.col(truth) & F.col(predicted)).cast("bigint"))
    either = F.sum((F.col(truth) | F.col(predicted)).cast("bigint"))
    return rows.groupBy(*keys).agg(F.when(either == 0, 1.0).otherwise(F.try_divide(both, either)).alias("j"))


def bound_radius(height: int, width: int, bound: float = 0.008) -> int:
    """The distance that still matches: a share of the diagonal rounded up, or pixels from 1 on."""
    return int(bound) if bound >= 1 else math.ceil(bound * math.hypot(height, width))


def boundary_f(pixels: DataFrame, height: int, width: int, key: str = "image", bound: float = 0.008) -> DataFrame:
    """(key, precision, recall, f) of the boundaries of ``truth`` and ``pred`` in pixels (key, r, c, truth, pred) of one size.

    One empty boundary gives precision or recall 1 to its own side and 0 to the other, two give 1 and 1.
    """
    from gridloom.operators import grids as G

    radius = bound_radius(height, width, bound)
    edges = {m: G.boundary(pixels.withColumn("m", F.col(m)), height, width, key).where("edge").select(key, "r", "c") for m in ("truth", "pred")}

    def matched(points: str, near: str, name: str) -> DataFrame:
        hit = edges[points].join(G.dilate(edges[near], radius, key).withColumn("hit", F.lit(1)), [key, "r", "c"], "left")
        return hit.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.count("hit").alias(f"hit_{name}"))

    rows = pixels.select(key).distinct().join(matched("pred", "truth", "p"), key, "left").join(matched("truth", "pred", "r"), key, "left")
    n_p, n_r = F.coalesce("n_p", F.lit(0)), F.coalesce("n_r", F.lit(0))
    precision = F.when(n_p == 0, 1.0).when(n_r == 0, 0.0).otherwise(F.col("hit_p") / n_p)
    recall = F.when(n_r == 0, 1.0).when(n_p == 0, 0.0).otherwise(F.col("hit_r") / n_r)
    rows = rows.select(key, precision.alias("precision"), recall.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def proposal_scores(pixels: DataFrame, group: str, frame: str, truth: str, predicted: str, objects: int, proposals: int) -> DataFrame:
    """(group, object, proposal, j): J of every object and proposal in every frame, averaged over the frames of the group.

    Labels of pixels are counted once (a confusion table a frame), so no pixel meets a pair. Proposals are padded to the
    number of objects; a label above them is an error.
    """
    if proposals < 1 or objects < 1:
        raise ValueError("there must be an object and a proposal")
    wide = max(objects, proposals)
    cells = pixels.groupBy(group, frame, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    above = F.raise_error(F.lit("a label is above the number of proposals")).cast("int")
    cells = cells.withColumn("p", F.when(F.col("p") > proposals, above).otherwise(F.col("p")))
    frames = cells.select(group, frame).distinct()
    every = frames.withColumn("object", F.explode(F.sequence(F.lit(1), F.lit(objects)))).withColumn("proposal", F.explode(F.sequence(F.lit(1), F.lit(wide))))
    t = cells.groupBy(group, frame, F.col("t").alias("object")).agg(F.sum("n").alias("nt"))
    p = cells.groupBy(group, frame, F.col("p").alias("proposal")).agg(F.sum("n").alias("np"))
    both = cells.select(group, frame, F.col("t").alias("object"), F.col("p").alias("proposal"), "n")
    rows = every.join(t, [group, frame, "object"], "left").join(p, [group, frame, "proposal"], "left").join(both, [group, frame, "object", "proposal"], "left").na.fill(0, ["nt", "np", "n"])
    union = F.col("nt") + F.col("np") - F.col("n")
    return rows.groupBy(group, "object", "proposal").agg(F.avg(F.when(union == 0, 1.0).otherwise(F.col("n") / union)).alias("j"))


def sequence_statistics(rows: DataFrame, keys: list[str], frame: str, value: str, wrap: bool = True) -> DataFrame:
    """(keys, mean, recall, decay): NaN frames left out of means; recall is the share over 0.5.

    Decay is the mean of the first quarter less that of the last, with edges (2 (n - 1) i + 4) div 8, both ends in. With
    ``wrap`` edges are bytes, as in the usual evaluation code: from 257 frames on they count modulo 256, and a
    quarter whose end comes before its start is empty and makes the decay null.
    """
    by = W.partitionBy(*keys)
    rows = rows.withColumns({"_i": F.row_number().over(by.orderBy(frame)) - 1, "_n": F.count("*").over(by)})
    ok = F.when(~F.isnan(value), F.col(value))
    plain = lambda i: F.floor((2 * (F.col("_n") - 1) * i + 4) / 8)
    edge = lambda i: F.pmod(plain(i), F.lit(256)) if wrap else plain(i)
    first, last = F.when(F.col("_i").between(edge(0), edge(1)), ok), F.when(F.col("_i").between(edge(3), edge(4)), ok)
    over = F.avg((F.coalesce(ok, F.lit(0.0)) > 0.5).cast("double"))
    return rows.groupBy(*keys).agg(F.avg(ok).alias("mean"), over.alias("recall"), (F.avg(first) - F.avg(last)).alias("decay"))


def hungarian(cost) -> list[int]:
    """The column of each row in a least-cost assignment of a matrix with at least as many columns as rows.

    Shortest augmenting paths with potentials, cubic time.
    """
    import numpy as np

    cost = np.asarray(cost, np.float64)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (now < least[1:])
            least[1:][better] = now[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def optimal_assignment(scores: DataFrame, group: str, row: str, column: str, score: str) -> DataFrame:
    """(group, row, column, score) of the one-to-one assignment of the greatest total; missing scores are 0.

    A group is one matrix of its objects and proposals (tens of each), so groups run in parallel.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=row, columns=column, values=score, fill_value=0.0).sort_index()
        flip = m.shape[0] > m.shape[1]
        a = m.to_numpy().T if flip else m.to_numpy()
        chosen = [(j, i) if flip else (i, j) for i, j in enumerate(hungarian(-a))]
        return pd.DataFrame({group: pdf[group].iloc[0], row: [m.index[i] for i, _ in chosen], column: [m.columns[j] for _, j in chosen], score: np.asarray([m.to_numpy()[i, j] for i, j in chosen], np.float64)})

    kind = lambda c: scores.schema[c].dataType.simpleString()
    return scores.select(group, row, column, score).groupBy(group).applyInPandas(run, f"{group} {kind(group)}, {row} {kind(row)}, {column} {kind(column)}, {score} double")

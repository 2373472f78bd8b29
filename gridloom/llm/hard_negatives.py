"""Hard negatives by branch and bound over ball trees, one tree a partition of the rows.

Rows are dealt to blocks by their place in a stored copy, so blocks are even whatever ids, labels and copies there are. The
task of a block builds a ball tree over its rows and searches it for a block of anchors at once. A node's
centre and radius bound an anchor's inner products with all its rows from above and below; a node is left out if
they lie outside the score window, or strictly below the k-th score found so far, or if its labels rule it out. Blocks'
best are ranked once more over all blocks, so every anchor meets every row that its bounds do not rule out.

Scores are inner products of integers, by floating-point matrix products where these are exact, else by Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import stored

#: Rows of a leaf; components in a block of rows and in one of anchors at the most; rows of a block at the least.
LEAF, BLOCK_CELLS, ANCHOR_CELLS, LEAST = 64, 1 << 23, 1 << 21, 1024
#: No row: below every score.
NONE = -(1 << 62)
#: Longs end here; a score beyond is given as this.
LONG = (1 << 63) - 1


class BallTree:
    """A binary tree of balls over integer vectors with labels, split at the median of the widest component."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        points = x.astype(np.float64)
        begin, end, left, right, centre, radius, low, high = ([] for _ in range(8))
        todo = [(0, len(x), -1, 0)]
        while todo:
            b, e, parent, side = todo.pop()
            if parent >= 0:
                (left, right)[side][parent] = len(begin)
            own = self.order[b:e]
            p = points[own]
            c = p.mean(axis=0)
            begin.append(b), end.append(e), left.append(-1), right.append(-1), centre.append(c)
            radius.append(np.sqrt(((p - c) ** 2).sum(axis=1).max()))
            low.append(labels[own].min()), high.append(labels[own].max())
            if e - b > leaf and radius[-1] > 0:
                wide = np.argmax(p.max(axis=0) - p.min(axis=0))
                half = (e - b) // 2
                self.order[b:e] = own[np.argpartition(p[:, wide], half)]
                todo += [(b, b + half, len(begin) - 1, 0), (b + half, e, len(begin) - 1, 1)]
        self.begin, self.end, self.left, self.right = begin, end, left, right
        self.centre, self.radius, self.low, self.high = np.asarray(centre), radius, low, high


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, nulls: np.ndarray, at: np.ndarray, labels: np.ndarray, anchors: dict, own: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, same: bool, k: int):
    """(query, row, score) of each query's first k rows with a score from floor to ceiling, ties by smaller id, null last.

    Query i is asked by anchor own[i] and takes rows of the same label but for itself, or of others. The last value is the share of
    query and row pairs that were looked at.
    """
    q, q_labels = anchors["v"], anchors["label"]
    width, n, m = x.shape[1], len(x), len(own)
    bits = n.bit_length()
    most = int(max(np.abs(x).max(initial=0), 1)) * int(max(np.abs(q).max(initial=0), 1)) * max(width, 1)
    exact, kind = most < 1 << 53 and most < 1 << (61 - bits), np.int64
    if not exact:
        x, q, kind = x.astype(object), q.astype(object), object
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    length = np.sqrt((qf**2).sum(axis=1))
    # Places by id: the first row has the greatest, so that scores and places rank as one number.
    first = np.lexsort((at, ids, nulls))
    place = np.empty(n, np.int64)
    place[first] = n - 1 - np.arange(n)
    none = NONE if exact else -(most + 1 << bits + 1)
    best = np.full((m, k), none, kind)
    looked, todo = 0, [(0, np.arange(m))]
    while todo:
        node, act = todo.pop()
        a = own[act]
        mid = qf[a] @ tree.centre[node]
        far = length[a] * tree.radius[node]
        far += 1e-9 * (np.abs(mid) + far) + 1e-6
        kth = best[act, -1] >> bits
        keep = (mid + far >= np.maximum(floor[act], kth)) & (mid - far <= ceiling[act])
        if same:
            keep &= (tree.low[node] <= q_labels[a]) & (q_labels[a] <= tree.high[node])
        else:
            keep &= (tree.low[node] != q_labels[a]) | (tree.high[node] != q_labels[a])
        keep = keep.astype(bool)
        act = act[keep]
        if not len(act):
            continue
        if tree.left[node] >= 0:
            sides = [tree.left[node], tree.right[node]]
            mean = qf[own[act]].mean(axis=0)
            sides.sort(key=lambda s: mean @ tree.centre[s])
            todo += [(s, act) for s in sides]
            continue
        rows = tree.order[tree.begin[node] : tree.end[node]]
        some, back = np.unique(own[act], return_inverse=True)
        scores = (np.rint(qf[some] @ xf[rows].T).astype(np.int64) if exact else q[some] @ x[rows].T)[back]
        a = own[act]
        alike = labels[rows][None, :] == q_labels[a][:, None]
        fit = (alike & (at[rows][None, :] != anchors["at"][a][:, None])) if same else ~alike
        fit &= ((scores >= floor[act][:, None]) & (scores <= ceiling[act][:, None])).astype(bool)
        looked += fit.size
        both = np.concatenate((best[act], np.where(fit, (scores << bits) + place[rows][None, :], none)), axis=1)
        best[act] = -np.sort(-both, axis=1)[:, :k]
    query, rank = np.nonzero(best != none)
    found = best[query, rank]
    row = first[n - 1 - (found & ((1 << bits) - 1)).astype(np.int64)]
    scores = [max(-LONG - 1, min(LONG, s)) for s in (found >> bits).tolist()]
    return query, row, np.asarray(scores, np.int64), looked / max(1, m * n)


def _matrix(column: pa.ChunkedArray, rows: int, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(rows, width)


def _hits(same: bool, k: int, low: int, high: int):
    """A task's search: its block's tree for its anchors, with a query an anchor, or one for each score of its positives."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"anchor": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        width = right["w"][0].as_py()
        x = _matrix(right["v"], right.num_rows, width)
        anchors = {"v": _matrix(left["anchor_v"], left.num_rows, width), "label": left["anchor_label"].to_numpy(), "at": left["anchor"].to_numpy()}
        p = left["scores"].to_pylist()
        own = np.repeat(np.arange(left.num_rows), [len(s) for s in p])
        p = np.asarray([s for some in p for s in some], np.int64)
        # Windows as Python's integers round them: low * p <= 100 * score <= high * p.
        floor = np.full(len(p), NONE) if same else np.asarray([-(-low * s // 100) for s in p.tolist()], np.int64)
        ceiling = np.full(len(p), LONG) if same else np.asarray([high * s // 100 for s in p.tolist()], np.int64)
        ids = right["id"]
        labels = right["label"].to_numpy()
        query, row, scores, _ = search(BallTree(x, labels), x, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), right["at"].to_numpy(), labels, anchors, own, floor, ceiling, same, k)
        return pa.table({"anchor": anchors["at"][own[query]], "p": p[query], "at": right["at"].to_numpy()[row], "id": ids.take(pa.array(row)), "score": scores})

    return run


def mine(
    rows: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "id",
    label_col: str = "label",
    vector_col: str = "v",
    leaf_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives the hardest negatives.

    ``rows`` has integer ids, labels and vectors (array of bigint). An anchor's positives are the ``positives`` other rows of its
    label with the highest inner products; negatives are rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's, highest first. Ties go to the smaller id, null ids last.

    Rows with a null label or vector, or a null component, take no part; vectors of another width than the anchor's do not meet it.
    Rows are told apart by themselves, so a repeated row is another row and a repeated anchor an anchor of its own. A null id is
    no anchor unless the condition says so. Scores beyond a long are given as the greatest. No rows give no rows.
    ``leaf_rows`` sets the rows of a block; by itself it grows with the root of their number up to BLOCK_CELLS components.
    """
    base = stored(
        rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<bigint>").alias("v"), F.coalesce(F.expr(is_anchor), F.lit(False)).alias("is_anchor"))
        .where("label is not null and v is not null and forall(v, x -> x is not null)")
        .withColumn("at", F.monotonically_increasing_id())
    )
    size = base.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).first()
    own = leaf_rows or min(max(int(8 * size["n"] ** 0.5), LEAST), max(LEAST, BLOCK_CELLS // max(1, size["w"])))
    blocks = max(1, -(-size["n"] // own))
    anchor_blocks = max(1, -(-size["a"] // max(256, ANCHOR_CELLS // max(1, size["w"]))))
    dealt = lambda at, n: F.pmod(F.xxhash64(at), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = base.select("at", "id", "label", "v", F.size("v").alias("w"), dealt("at", blocks).alias("rb"), every(anchor_blocks).alias("ab"))
    anchors = base.where("is_anchor").select(F.col("at").alias("anchor"), F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("anchor_v"))

    def hits(asked: DataFrame, same: bool, k: int) -> DataFrame:
        left = asked.select("anchor", "anchor_label", "anchor_v", "scores", F.size("anchor_v").alias("w"), dealt("anchor", anchor_blocks).alias("ab"), every(blocks).alias("rb"))
        found = left.groupBy("w", "ab", "rb").cogroup(right.groupBy("w", "ab", "rb")).applyInArrow(_hits(same, k, low, high), "anchor bigint, p bigint, at bigint, id bigint, score bigint")
        order = W.partitionBy("anchor", "p").orderBy(F.desc("score"), F.asc_nulls_last("id"), "at")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    one = anchors.withColumn("scores", F.array(F.lit(0).cast("bigint")))
    best = stored(hits(one, True, positives).select("anchor", F.col("id").alias("positive_id"), F.col("at").alias("positive"), F.col("score").alias("positive_score")))
    # A negative score's window is empty; positives of equal score share one search.
    asked = best.where("positive_score >= 0").groupBy(F.col("anchor").alias("asking")).agg(F.collect_set("positive_score").alias("scores"))
    second = anchors.join(asked, F.col("anchor") == F.col("asking")).drop("asking")
    found = hits(second, False, negatives).select(F.col("anchor").alias("of"), "p", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    names = base.where("is_anchor").select(F.col("at").alias("named"), F.col("id").alias("anchor_id"))
    joined = best.join(found, (F.col("anchor") == F.col("of")) & (F.col("positive_score") == F.col("p"))).join(names, F.col("anchor") == F.col("named"))
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, v): components as floor(scale * x) of double x; rows with a null label or vector or a component that is null or not finite are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = rows.where(F.col(label_col).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return good.select(F.col(id_col).alias("id"), F.col(label_col).cast("bigint").alias("label"), F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("bigint")).alias("v"))

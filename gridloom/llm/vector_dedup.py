"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class first. Each pass draws random hyperplanes, and a class's key is the string of
its signs: concatenated random hashes, by which the pass range-sorts the classes lexicographically. The order is cut into
contiguous windows of WINDOW classes, and each window is compared with itself and with the next one, whatever prefix their keys
share. Pairs with a cosine of at least the threshold in double precision are joined to components across passes.

A run of classes that share the leading ``bits`` of the key may be longer than that, as dense vectors make it; then the windows it covers
are compared with each other to the end, so any two classes of a run meet. A pair at the threshold shares a run with the
chance (1 - angle / pi) ** bits in a pass, whatever the other vectors are, so the number of passes follows from ``bits`` and the
stated chance MISS to lose it; ``bits`` follows from the number of classes and the angles of a sample, for the least
work. The same rule holds for every size. Dense vectors take time, not recall.

At the end the links inside each component are counted in full, window by window; only counts leave a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checkpoint, release, stored, type_of
from gridloom.llm.components import connected_components

#: The chance to miss a pair at the threshold, the fewest and the most leading bits of a run, comparisons that cost
#: as much as moving a vector, classes sampled for the choice between them, and classes of a window.
MISS, FEWEST, BITS, MOVE, SAMPLE, WINDOW = 1e-5, 4, 24, 2_000, 2_000, 512
#: Classes of a window in the count of links.
COUNT_WINDOW = 1024


def _planes(dimension: int, number: int, bits: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([number, 7])).standard_normal((dimension, bits))


def _matrix(column, dtype) -> np.ndarray:
    """Unit rows in double precision of vectors of one length; scaled first, so squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(column), dtype).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def raw_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, raw binary): the components as they are; null where the vector can link with nothing."""
    dtype = dtype_of(table, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.values.to_numpy(zero_copy_only=False).astype(dtype)  # null components become NaN
            at = lists.offsets.to_numpy()
            good = np.isfinite(values)
            bad = np.concatenate(([0], np.cumsum(~good)))
            some = np.concatenate(([0], np.cumsum(good & (values != 0))))
            usable = (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]]) & np.asarray(lists.is_valid())
            # Adding 0.0 makes negative zeros positive.
            raw = [(values[i:j] + dtype(0)).tobytes() if ok else None for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), usable.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, f"id {type_of(table, id_col)}, raw binary")


def dtype_of(table: DataFrame, vector_col: str) -> type:
    """Float vectors stay floats while they move; all others are doubles. Cosines are always of doubles."""
    return np.float32 if type_of(table, vector_col) == "array<float>" else np.float64


def passes_for(bits: int, cosine: float, miss: float = MISS) -> int:
    """Passes that leave a pair of the given cosine without a common bucket with a chance of at most ``miss``."""
    shared = (1 - np.arccos(cosine) / np.pi) ** bits
    return 1 if shared >= 1 else int(np.ceil(np.log(miss) / np.log1p(-shared)))


def bits_for(count: int, raws: list[bytes], cosine: float, dtype: type = np.float64, miss: float = MISS) -> int:
    """Leading bits of the least work, moves and comparisons, by the angles of sampled classes."""
    share, sizes = np.zeros(BITS + 1), np.asarray([len(u) for u in raws])
    for size in np.unique(sizes):
        x = _matrix([u for u in raws if len(u) == size], dtype)
        same = 1 - np.arccos(np.clip((x @ x.T)[np.triu_indices(len(x), 1)], -1, 1)) / np.pi
        share += [(same**b).sum() for b in range(BITS + 1)]
    mates = count * share / max(len(raws) * (len(raws) - 1) // 2, 1)
    return min(range(FEWEST, BITS + 1), key=lambda b: passes_for(b, cosine, miss) * (MOVE * max(mates[b] / WINDOW, 1) + mates[b]))


def _keyed(classes: DataFrame, passes: int, bits: int, dtype: type) -> DataFrame:
    """(pass, size, run, key, id) for all passes: the whole key and its leading bits; vectors are joined after counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            raws = batch.column(1).to_pylist()
            sizes = np.asarray([len(u) for u in raws])
            for p in range(passes):
                key = np.zeros(len(raws), np.int64)
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    x = _matrix([raws[i] for i in own], dtype)
                    key[own] = ((x @ _planes(x.shape[1], p, BITS)) > 0).astype(np.int64) @ place
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raws), p, np.int32)), pa.array(sizes.astype(np.int32)), pa.array(key >> (BITS - bits)), pa.array(key), batch.column(0)], names=["pass", "size", "run", "key", "id"])

    return classes.select("id", "raw").mapInArrow(run, f"pass int, size int, run bigint, key bigint, id {type_of(classes, 'id')}")


def spanning_links(x: np.ndarray, y: np.ndarray | None, cosine: float) -> list[tuple[int, int]]:
    """Pairs of rows of x (or of x and y, whose rows count on from x's) that join what all links join."""
    both = x if y is None else np.concatenate((x, y))
    label, out = np.arange(len(both)), []
    base = 0 if y is None else len(x)
    for start in range(0, len(x), 256):
        near = (x[start : start + 256] @ both[base:].T) >= cosine
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            i = start + k
            js = np.flatnonzero(near[k]) + base
            others, first = np.unique(label[js], return_index=True)
            for other, at in zip(others.tolist(), first.tolist(), strict=True):
                if other != label[i]:
                    out.append((i, int(js[at])))
                    label[label == other] = label[i]
    return out


def _ordered(keys: DataFrame) -> DataFrame:
    """The keyed rows with their place in the order of pass, size and key; ties go by a hash of the id, so that a frequent key spreads.

    The range-sorted rows are stored, so that a row's partition and its place in it are fixed; only partitions' sizes reach the driver.
    """
    order = ["pass", "size", "key", "h", "id"]
    rows = keys.withColumn("h", F.xxhash64("id"))
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("h"))
    part = F.shiftright("at", 33).cast("int")
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).tolist()
    # One row a partition.
    offsets = F.broadcast(rows.sparkSession.createDataFrame([(p, at) for (p, _), at in zip(sizes, starts, strict=False)], "part int, start bigint"))
    place = F.col("start") + (F.col("at") - F.shiftleft(F.col("part").cast("bigint"), 33))
    return rows.withColumn("part", part).join(offsets, "part").select("pass", "size", "run", "id", place.alias("place"))


def _window_links(classes: DataFrame, passes: int, bits: int, cosine: float, dtype: type) -> DataFrame:
    """Verified pairs (a, b) that join what the links join of each window with itself and the next, and of the windows of each long run."""
    rows = _ordered(_keyed(classes, passes, bits, dtype)).withColumn("w", F.floor(F.col("place") / WINDOW))
    columns = ["pass", "size", "id", "w0", "w1", "right"]
    side = lambda w, right: F.struct(w.alias("w0"), (w + 1).alias("w1"), F.lit(right).alias("right"))
    near = rows.select("pass", "size", "id", F.inline(F.array(side(F.col("w"), False), side(F.col("w") - 1, True)))).where("w0 >= 0")
    long = rows.groupBy("pass", "size", "run").agg(F.min("w").alias("a"), F.max("w").alias("b")).where("b - a >= 2")
    far = rows.join(long, ["pass", "size", "run"]).withColumn("other", F.explode(F.sequence("a", "b"))).where("abs(other - w) >= 2")
    far = far.select("pass", "size", "id", F.least("w", "other").alias("w0"), F.greatest("w", "other").alias("w1"), (F.col("w") > F.col("other")).alias("right"))
    sent = near.select(*columns).unionByName(far.select(*columns)).join(classes.select("id", "raw"), "id")
    kind = type_of(classes, "id")

    def compare(table: pa.Table) -> pa.Table:
        # A window may hold the end of one pass and the start of the next.
        table = table.sort_by([("pass", "ascending"), ("size", "ascending"), ("right", "ascending"), ("id", "ascending")])
        right, ids, raws = table["right"].to_numpy(zero_copy_only=False), table["id"].combine_chunks(), table["raw"].to_pylist()
        part = table["pass"].to_numpy().astype(np.int64) << 32 | table["size"].to_numpy()
        beside = table["w1"][0].as_py() == table["w0"][0].as_py() + 1
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        pairs = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            x, n = _matrix(raws[i:j], dtype), int((~right[i:j]).sum())
            found = spanning_links(x[:n], None, cosine) if beside else []
            pairs += [(i + k, i + m) for k, m in (*found, *(spanning_links(x[:n], x[n:], cosine) if 0 < n < j - i else ()))]
        take = lambda side: ids.take(pa.array([p[side] for p in pairs], pa.int64()))
        return pa.table({"a": take(0), "b": take(1)})

    return sent.groupBy("w0", "w1").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _count_links(members: DataFrame, cosine: float, dtype: type) -> DataFrame:
    """(id, links): for each class, the vectors of other classes of its component with a cosine of at least ``cosine``.

    members: (component, id, raw, copies). Pairs of windows of a component meet; each class keeps its sum.
    """
    counts = members.groupBy("component").agg(F.ceil(F.count("*") / COUNT_WINDOW).cast("int").alias("windows"))
    rows = members.join(counts, "component").withColumn("window", F.pmod(F.xxhash64("id"), F.col("windows")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    rows = rows.select("component", F.least("window", "other").alias("w0"), F.greatest("window", "other").alias("w1"), (F.col("window") > F.col("other")).alias("right"), "id", "raw", "copies")
    kind = type_of(members, "id")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x, copies = _matrix(pdf["raw"].to_numpy(), dtype), pdf["copies"].to_numpy()
        if pdf["w0"].iloc[0] == pdf["w1"].iloc[0]:
            near = (x @ x.T) >= cosine
            np.fill_diagonal(near, False)
            return pd.DataFrame({"id": pdf["id"], "links": near @ copies})
        r = pdf["right"].to_numpy()
        near = (x[~r] @ x[r].T) >= cosine
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"id": np.concatenate((ids[~r], ids[r])), "links": np.concatenate((near @ copies[r], near.T @ copies[~r]))})

    parts = rows.groupBy("component", "w0", "w1").applyInPandas(count, f"id {kind}, links bigint")
    return parts.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, bits: int | None = None, miss: float = MISS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing, as do rows
    without an id; vectors of different lengths never link. Equal vectors link with each other.
    Rows that repeat an id are one vector, the first in byte order where they differ, and each has its
    figures. Other columns are left aside; no rows give no rows. A pair at the threshold is missed
    with a chance of at most ``miss``, a nearer pair with less. ``bits`` fixes the leading bits of a run instead of
    their choice by size. Building the result runs jobs.
    """
    dtype = dtype_of(table, vector_col)
    rows = checkpoint(raw_vectors(table, id_col, vector_col))
    valid = rows.where("raw is not null and id is not null")
    repeated = checkpoint(valid.groupBy("id").count().where("count > 1").select("id"))
    if not repeated.isEmpty():
        one = valid.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("raw").alias("raw"))
        valid = checkpoint(valid.join(repeated, "id", "left_anti").unionByName(one))
    classes = checkpoint(valid.groupBy("raw").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    if bits is None:
        # By a hash of the id, so that the sample is the same each time.
        bits = bits_for(classes.count(), [bytes(r["raw"]) for r in classes.select("raw").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()], cosine, dtype, miss)
    found = checkpoint(_window_links(classes, passes_for(bits, cosine, miss), bits, cosine, dtype))
    release(table.sparkSession)
    parts = connected_components(found)
    members = classes.join(parts, "id")
    links = _count_links(members.select("component", "id", "raw", "copies"), cosine, dtype)
    named = classes.join(parts, "id", "left").join(links, "id", "left")
    named = named.select("raw", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # Each id has one class now; rows without one stay alone.
    own = valid.join(named, "raw").select(F.col("id").alias("own"), "component", "links")
    out = rows.select("id", "raw").join(own, F.col("raw").isNotNull() & (F.col("id") == F.col("own")), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )

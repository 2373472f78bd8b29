"""Near-duplicate documents by HyperMinHash, banding and exact verification.

1. One pass sketches each text: its distinct 5-word shingles fall in 128 buckets, and a bucket keeps its
   smallest hash as a 16-bit register, 6 bits of leading zeros and 10 bits of mantissa.
2. Texts of equal shingle sets are one class, found by a 128-bit digest of the set.
3. Classes are banded by five registers at a time (empty ones borrow another's), 25 bands in all: a pair of
   similarity 0.85 misses all bands with a chance near 4e-7. A lower threshold takes shorter bands, the longest
   whose chance to miss a pair at it is below MISS: four registers and 32 bands at 0.80, with 5e-8.
4. Each class is compared with one class of its bands: pairs whose collision-corrected Jaccard estimate from the registers
   is near the threshold are verified on full sets, and links are joined to components. Bands whose
   members then still lie in several components are compared to the end, in tiles of bounded size: registers
   alone first leave the members with a likely partner of another component, then the full sets of
   those join them and decide. No tile emits more links than it has members.

So no bucket is capped and no pair list grows with the square of a group: a group of near copies
costs one comparison a member, and the rest is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, checkpoint, release, type_of, whole_row
from gridloom.llm.components import connected_components
from gridloom.llm.hashing import combine, mix, shingle_sets

K, ROWS, MANTISSA, EMPTY = 128, 5, 10, 0xFFFF
#: The most that the chance to miss a pair at the threshold may be, where bands can be made that short.
MISS = 1e-6
#: Members of a tile, and the slack of the estimate: over seven standard deviations at 128 registers and 0.80 or 0.85.
TILE, SLACK = 512, 0.25
_U = np.uint64
_PROBES = np.stack([np.random.Generator(np.random.PCG64(k)).permutation(K) for k in range(K)])


def registers(shingles: np.ndarray) -> np.ndarray:
    """The HyperMinHash of a set of 64-bit hashes: K registers, EMPTY where no shingle fell."""
    out = np.full(K, EMPTY, np.uint16)
    if not len(shingles):
        return out
    # Seven bits choose the bucket, 57 bits of another hash are minimised.
    value = mix(shingles ^ _U(0x5851F42D4C957F2D)) >> _U(7)
    key = np.sort(((shingles & _U(K - 1)) << _U(57)) | value)
    bucket = (key >> _U(57)).astype(np.int64)
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    least = key[first] & _U((1 << 57) - 1)
    _, exponent = np.frexp(least.astype(np.float64))
    bits = np.minimum(exponent.astype(np.int64), 57)  # length in bits; rounding up to 2**57 counts as 57
    up = np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64)
    down = np.maximum(bits - MANTISSA - 1, 0).astype(np.uint64)
    mantissa = ((least << up) >> down) & _U((1 << MANTISSA) - 1)
    out[bucket[first]] = (((57 - bits) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)
    return out


def densify(reg: np.ndarray) -> np.ndarray:
    """Empty registers take the first full one in a fixed random order of their own."""
    empty = np.flatnonzero(reg == EMPTY)
    if len(empty) and len(empty) < K:
        full = reg[_PROBES[empty]] != EMPTY
        reg = reg.copy()
        source = _PROBES[empty, full.argmax(axis=1)]
        reg[empty] = reg[source]
    return reg


def rows_for(percent: int) -> int:
    """Registers of a band: at most ROWS, and as many as keep the chance to miss a pair at the threshold below MISS."""
    miss = lambda rows: (1 - (percent / 100) ** rows) ** (K // rows)
    return max((rows for rows in range(1, ROWS + 1) if miss(rows) < MISS), default=1)


def bands(reg: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band, of its registers and its number."""
    number = K // rows
    table = densify(reg)[: number * rows].astype(np.uint64).reshape(number, rows)
    return combine([*table.T, np.arange(number, dtype=np.uint64)])


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard of register rows a and b of sets of n and m members, less the expected random collisions."""
    full = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & full).sum(axis=-1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    random = 0.1699 * K / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(same - random, 0) / np.maximum(full.sum(axis=-1), 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, digest, reg) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1 << 18):
            sets = shingle_sets(_texts(batch), size)
            digests = [_digest(s) for s in sets]
            regs = [registers(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n_shingles", "digest", "reg"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {type_of(docs, id_col)}, n_shingles bigint, digest binary, reg binary")


def _band_rows(classes: DataFrame, size: int) -> DataFrame:
    """(id, band) for each class and band of ``size`` registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [bands(np.frombuffer(r, np.uint16), size).view(np.int64) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["id", "bands"])

    kind = type_of(classes, "id")
    return classes.select("id", "reg").mapInArrow(run, f"id {kind}, bands array<bigint>").select("id", F.explode("bands").alias("band"))


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, shingles binary) of the wanted (id, digest) only."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted.select("id", "digest"), "id").select("id", "text", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1 << 18):
            sets = shingle_sets(_texts(batch), size)
            own = pa.array([_digest(s) == d for s, d in zip(sets, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"]).filter(own)

    return rows.mapInArrow(run, f"id {type_of(docs, id_col)}, shingles binary").dropDuplicates(["id"])


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate from the registers is not far below the threshold."""
    facts = classes.select("id", "n", "reg")
    rows = pairs.join(facts.toDF("a", "na", "ra"), "a").join(facts.toDF("b", "nb", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, K) for k in (4, 5))
            near = estimate(ra, rb, batch.column(2).to_numpy(), batch.column(3).to_numpy()) >= percent / 100 - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    kind = type_of(pairs, "a")
    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    rows = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            keep = [linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), percent) for x, y in zip(sa, sb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = type_of(pairs, "a")
    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _tiles(members: DataFrame) -> DataFrame:
    """members (band, id, comp, n, reg, tiles) with the tile pairs (t0, t1) of their bands in which each is, and whether on the right."""
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    rows = members.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.select("band", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), (F.col("tile") > F.col("other")).alias("right"), "id", "comp", "n", "reg")


class _Tile:
    """One pair of tiles: its members in the order of their ids, and who of the later ones may link with each."""

    def __init__(self, table: pa.Table, percent: int):
        self.ids, self.comps = table["id"].to_pylist(), table["comp"].to_pylist()
        self.order = np.asarray(sorted(range(len(self.ids)), key=lambda i: self.ids[i]))
        self.number = np.unique(np.asarray(self.comps, dtype=object if isinstance(self.comps[0], str) else None), return_inverse=True)[1]
        self.reg = np.frombuffer(b"".join(table["reg"].to_pylist()), np.uint16).reshape(-1, K)
        self.n = table["n"].to_numpy()
        self.right = np.asarray(table["right"].to_pylist(), bool)
        self.one = table["t0"][0].as_py() == table["t1"][0].as_py()
        self.least = percent / 100 - SLACK

    def likely(self) -> Iterator[tuple[int, np.ndarray]]:
        for at, i in enumerate(self.order.tolist()):
            rest = self.order[at + 1 :]
            rest = rest[self.number[rest] != self.number[i]]
            if not self.one:
                rest = rest[self.right[rest] != self.right[i]]
            if len(rest):
                yield i, rest[estimate(self.reg[i], self.reg[rest], self.n[i], self.n[rest]) >= self.least]


def _marked(members: DataFrame, percent: int) -> DataFrame:
    """The rows of ``_tiles`` that have a likely partner of another component in their tile pair; registers decide, no sets move."""

    def mark(table: pa.Table) -> pa.Table:
        tile, own = _Tile(table, percent), np.zeros(table.num_rows, bool)
        for i, rest in tile.likely():
            own[rest] = True
            own[i] |= len(rest) > 0
        return table.filter(pa.array(own))

    rows = _tiles(members)
    kind = type_of(members, "id")
    return rows.groupBy("band", "t0", "t1").applyInArrow(mark, f"band bigint, t0 int, t1 int, right boolean, id {kind}, comp {kind}, n bigint, reg binary")


def _tile_links(marked: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside each band, a spanning set of them from each pair of tiles; marked rows with their sets."""

    def compare(table: pa.Table) -> pa.Table:
        tile, root, sets = _Tile(table, percent), {}, {}
        a, b = [], []

        def find(x):
            while x in root:
                x = root[x]
            return x

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.frombuffer(table["shingles"][i].as_buffer(), _U)
            return sets[i]

        for i, rest in tile.likely():
            for j in rest.tolist():
                x, y = find(tile.comps[i]), find(tile.comps[j])
                if x != y and linked(shingles(i), shingles(j), percent):
                    root[max(x, y)] = min(x, y)
                    a.append(tile.ids[i])
                    b.append(tile.ids[j])
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    kind = type_of(marked, "id")
    return marked.groupBy("band", "t0", "t1").applyInArrow(compare, f"a {kind}, b {kind}")


def _placed(banded: DataFrame, parts: DataFrame) -> DataFrame:
    """(band, id, comp) with each member's component so far."""
    return checkpoint(banded.select("band", "id").join(parts, "id", "left").select("band", "id", F.coalesce("component", "id").alias("comp")))


def _open(placed: DataFrame) -> DataFrame:
    """(band, m) of bands whose m members lie in several components; of bands with the same members one is enough."""
    mark = [F.sum(F.xxhash64("id", F.lit(s)).cast("decimal(38,0)")).alias(f"x{s}") for s in (1, 2)]
    bands_ = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), *mark).where("lo < hi")
    return bands_.groupBy("m", "x1", "x2").agg(F.min("band").alias("band")).select("band", "m")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Null, empty and blank texts have no shingles and link with nothing; so do rows without an id (component null).
    Repeated rows of one id are one document: of several texts with words, that of the smallest digest stands for all.
    Ties need no rule: a component is named by its smallest id. Other columns are left aside; no rows give no
    rows. Building the result runs jobs.
    """
    rows = checkpoint(sketch(docs, id_col, text_col, size))
    valid = rows.where("n_shingles > 0 and id is not null")
    several = checkpoint(valid.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("id", "least"))
    if not several.isEmpty():
        named = F.when(F.col("digest").isNotNull(), F.coalesce("least", "digest"))
        valid = checkpoint(valid.join(several, "id", "left").where("least is null or least = digest").drop("least"))
        rows = checkpoint(rows.join(several, "id", "left").select("id", "n_shingles", named.alias("digest")))
    classes = valid.groupBy("digest").agg(F.min("id").alias("id"), F.min("n_shingles").alias("n"), F.min_by("reg", "id").alias("reg"))
    classes = checkpoint(classes)
    banded = _band_rows(classes, rows_for(percent))
    shared = banded.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").drop("last")
    banded = checkpoint(banded.join(shared, "band").select("band", "id", "pivot"))
    release(docs.sparkSession)
    first = banded.where("pivot < id").groupBy("id").agg(F.min("pivot").alias("b")).select(F.col("id").alias("a"), "b")
    first = checkpoint(_likely(first, classes, percent))
    # One pass over the texts, whichever pairs need their sets later.
    sets = checkpoint(_sets(docs, classes.join(banded.select("id").distinct(), "id"), id_col, text_col, size))
    release(docs.sparkSession)
    links = checkpoint(_verify(first, sets, percent))
    release(docs.sparkSession)
    parts = connected_components(links)
    placed = _placed(banded, parts)
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    open_ = placed.join(_open(placed).select("band", tiles.alias("tiles")), "band").join(classes.select("id", "n", "reg"), "id")
    marked = checkpoint(_marked(open_.select("band", "id", "comp", "n", "reg", "tiles"), percent))
    release(docs.sparkSession)
    more = checkpoint(_tile_links(marked.join(sets, "id"), percent))
    release(docs.sparkSession)
    parts = connected_components(links.union(more))
    names = classes.select("digest", "id").join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    digest: Column = F.when(F.col("id").isNotNull(), F.col("digest"))
    out = rows.select("id", "n_shingles", digest.alias("d")).join(names, F.col("d") == F.col("digest"), "left")
    component = F.coalesce("component", "id")
    kept = F.col("component_id").eqNullSafe(F.col("id"))
    return out.select("id", "n_shingles", component.alias("component_id")).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def _one_of_each_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with an id, one of each: of repeated ones that of the smallest text, null last; the whole row decides ties."""
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).count().where("count > 1").select("_again")
    repeated = checkpoint(repeated)
    rows = docs.where(F.col(id_col).isNotNull()).select(whole_row(docs).alias("_row"), F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    if repeated.isEmpty():
        return rows.select("_row.*")
    place = F.struct(F.col("_text").isNull(), F.col("_text"), F.to_json("_row"))
    one = rows.join(repeated, F.col("_key") == F.col("_again"), "left_semi").groupBy("_key").agg(F.min_by("_row", place).alias("_row"))
    return rows.join(repeated, F.col("_key") == F.col("_again"), "left_anti").select("_row.*").union(one.select("_row.*"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row of the smallest id of each component, with all its columns.

    Repeated rows of one id are one document: one row stays, that of the smallest text. Rows without an id
    are documents of their own, compared by their texts like all others, and come after all ids.
    """
    named = _one_of_each_id(docs, id_col, text_col)
    if docs.where(F.col(id_col).isNull()).isEmpty():
        gone = near_duplicates(named, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("_gone"))
        rows = named.select(whole_row(named).alias("_row"), named[id_col].alias("_key"))
        return rows.join(gone, F.col("_key") == F.col("_gone"), "left_anti").select("_row.*")
    # Numbered once and kept, so that a row has the same key each time it is read.
    nameless = docs.where(F.col(id_col).isNull())
    whole = lambda d, key: d.select(whole_row(d).alias("_row"), key.alias("_key"), d[id_col].alias("_id"), d[text_col].alias("_text"))
    nameless = checkpoint(whole(nameless, F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string"))))
    rows = whole(named, F.concat(F.lit("i"), F.col(id_col).cast("string"))).union(nameless)
    parts = near_duplicates(rows, "_key", "_text", **options).select(F.col("_key").alias("_k"), "component_id")
    parts = checkpoint(parts.join(rows.select(F.col("_key"), "_id"), F.col("_k") == F.col("_key")).select("_k", "_id", "component_id"))
    first = parts.groupBy("component_id").agg(F.min_by("_k", F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_k"))).alias("_stays"))
    return rows.join(first.select("_stays"), F.col("_key") == F.col("_stays"), "left_semi").select("_row.*")

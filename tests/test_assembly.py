import pytest
from pyspark.sql import functions as F

from gridloom.operators import assembly as A


def encode(counts):
    """Brute force: signed groups of five bits, low first."""
    out = ""
    for i, x in enumerate(counts):
        x -= counts[i - 2] if i > 2 else 0
        while True:
            group, x = x & 31, x >> 5
            more = x != (-1 if group & 16 else 0)
            out += chr((group | 32 * more) + 48)
            if not more:
                break
    return out


@pytest.mark.parametrize("counts", [[], [0], [5], [0, 7, 3], [6, 1, 40, 4, 5, 4, 5, 4, 21], [15, 16, 31, 32, 511, 512, 0, 100_000], [3_000_000, 1, 2, 3_000_000, 1, 1]])
def test_compressed_counts(spark, counts):
    row = spark.range(1).select(F.lit(counts).cast("array<bigint>").alias("n")).select("n", A.compress_counts(F.col("n")).alias("t")).select("n", "t", A.expand_counts(F.col("t")).alias("back")).first()
    assert row["t"] == encode(counts)
    assert row["back"] == counts


def test_cap_and_pad(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([],), (None,), ([1],)], "v array<int>").select(A.cap_and_pad(F.col("v"), 2).alias("v")).collect()
    assert [r["v"] for r in rows] == [[1, 2], [-1, -1], [-1, -1], [1, -1]]
    with pytest.raises(ValueError):
        A.cap_and_pad(F.lit(None), 0)


def test_prefix(spark):
    rows = spark.createDataFrame([([1], [1, 2]), ([], [1]), ([2], [1, 2]), ([1, 2], [1])], "a array<int>, b array<int>").select(A.is_prefix(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r["p"] for r in rows] == [True, True, False, False]


@pytest.mark.parametrize(("height", "width", "n"), [(25, 20, 7), (10, 10, 1), (9, 31, 20), (5, 5, 4)])
def test_grid_proposals(spark, height, width, n):
    grid = spark.range(height * width).select((F.col("id") % height).cast("int").alias("r"), F.expr(f"cast(id div {height} as int)").alias("c"))
    side = next(k for k in range(1, 100) if k * k >= n)
    edges = [[k * size // side for k in range(side + 1)] for size in (height, width)]
    for r in A.grid_proposals(grid, height, width, n).collect():
        i, j = (next(k for k in range(side) if e[k] <= x < e[k + 1]) for e, x in zip(edges, (r["r"], r["c"]), strict=True))
        expected = i * side + j + 1
        assert r["proposal"] == (expected if expected <= n else 0)


def test_interior_checks_its_border(spark):
    with pytest.raises(ValueError):
        A.interior(spark.range(1), 2, 2, 0.5)


def test_masks_without_objects(spark):
    frames = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 3)], "frame int, r int, c int, label int")
    assert A.object_masks(frames, "frame", "label").count() == 0

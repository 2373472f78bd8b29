"""Grid operators on pixel rows (image, r, c, x): interpolation, pooling, boundaries, dilation, run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.vectors import dot


def band_join(left: DataFrame, right: DataFrame, reach: int, key: str) -> DataFrame:
    """Pairs of points of one key within ``reach`` rows and columns.

    Points are bucketed by r div (reach + 1) and c div (reach + 1); a point probes its nine neighbouring
    buckets by equi-join and the exact predicate is checked again, so each pair comes once.
    """
    cell = reach + 1
    near = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    probe = left.withColumn("_br", F.explode(F.transform(near, lambda d: F.floor(F.col("r") / cell) + d)))
    probe = probe.withColumn("_bc", F.explode(F.transform(near, lambda d: F.floor(F.col("c") / cell) + d)))
    build = right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"{c}2") for c in right.columns if c != key])
    build = build.withColumn("_br2", F.floor(F.col("r2") / cell)).withColumn("_bc2", F.floor(F.col("c2") / cell))
    on = (F.col(key) == F.col("_k")) & (F.col("_br") == F.col("_br2")) & (F.col("_bc") == F.col("_bc2"))
    exact = (F.abs(F.col("r") - F.col("r2")) <= reach) & (F.abs(F.col("c") - F.col("c2")) <= reach)
    return probe.join(build, on & exact).drop("_br", "_bc", "_br2", "_bc2", "_k")


def resize_nearest(grid: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Nearest neighbour by src = floor(dst * in / out)."""
    spark = grid.sparkSession
    rows = spark.range(new_height).select(F.col("id").cast("int").alias("nr"), F.floor(F.col("id") * height / new_height).cast("int").alias("r"))
    cols = spark.range(new_width).select(F.col("id").cast("int").alias("nc"), F.floor(F.col("id") * width / new_width).cast("int").alias("c"))
    return grid.join(F.broadcast(rows), "r").join(F.broadcast(cols), "c").drop("r", "c").withColumnsRenamed({"nr": "r", "nc": "c"})


def _taps(spark, name: str, size: int, new: int, ratio: float | None = None) -> DataFrame:
    """(new index, source index, weight) of linear interpolation at half-pixel centres with clamped edges; ``ratio`` is size / new if not given."""
    at = F.greatest((F.col("id") + 0.5) * (F.lit(size) / new if ratio is None else F.lit(ratio)) - 0.5, F.lit(0.0))
    low = F.floor(at)
    t = spark.range(new).select(F.col("id").cast("int").alias(f"n{name}"), low.alias("lo"), (at - low).alias("f"))
    pairs = F.array(F.struct(F.least(F.col("lo"), F.lit(size - 1)).cast("int").alias(name), (1 - F.col("f")).alias(f"w{name}")), F.struct(F.least(F.col("lo") + 1, F.lit(size - 1)).cast("int").alias(name), F.col("f").alias(f"w{name}")))
    return t.select(f"n{name}", F.inline(pairs))


def _cubic_taps(spark, name: str, size: int, new: int, a: float = -0.75) -> DataFrame:
    """(new index, source index, weight) of cubic convolution: four taps at half-pixel centres, indices clamped to the edges."""
    at = (F.col("id") + 0.5) * size / new - 0.5
    f = at - F.floor(at)
    inner = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    outer = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    weights = (outer(f + 1), inner(f), inner(1 - f), outer(2 - f))
    place = lambda k: F.greatest(F.least(F.floor(at) + k - 1, F.lit(size - 1)), F.lit(0)).cast("int")
    pairs = F.array(*[F.struct(place(k).alias(name), w.cast("double").alias(f"w{name}")) for k, w in enumerate(weights)])
    return spark.range(new).select(F.col("id").cast("int").alias(f"n{name}"), F.inline(pairs))


def _weighted(grid: DataFrame, rows: DataFrame, cols: DataFrame, key: str) -> DataFrame:
    """Taps have at most four rows an output row or column and are broadcast for that bound."""
    joined = grid.join(F.broadcast(rows), "r").join(F.broadcast(cols), "c")
    out = joined.groupBy(key, "nr", "nc").agg(F.sum(F.col("x") * F.col("wr") * F.col("wc")).alias("x"))
    return out.select(key, F.col("nr").alias("r"), F.col("nc").alias("c"), "x")


def resize_bilinear(grid: DataFrame, height: int, width: int, new_height: int, new_width: int, key: str = "image") -> DataFrame:
    """Bilinear interpolation with half-pixel centres and clamped edges."""
    spark = grid.sparkSession
    return _weighted(grid, _taps(spark, "r", height, new_height), _taps(spark, "c", width, new_width), key)


def centre_square(grid: DataFrame, height: int, width: int, side: int, key: str = "image", labels: bool = False) -> DataFrame:
    """The shorter side resized to ``side``, the longer in proportion and rounded down, then the square in the middle.

    Values are interpolated; ``labels`` are taken from the nearest pixel under the same geometry.
    """
    if side < 1:
        raise ValueError("a side has at least one pixel")
    new_height, new_width = (side, side * width // height) if height <= width else (side * height // width, side)
    resized = resize_nearest(grid, height, width, new_height, new_width) if labels else resize_bilinear(grid, height, width, new_height, new_width, key)
    # Half of what is over goes to either side, halves to the even number.
    top, left = round((new_height - side) / 2), round((new_width - side) / 2)
    inside = resized.where(F.col("r").between(top, top + side - 1) & F.col("c").between(left, left + side - 1))
    return inside.withColumn("r", (F.col("r") - top).cast("int")).withColumn("c", (F.col("c") - left).cast("int"))


def resize_bicubic(grid: DataFrame, height: int, width: int, new_height: int, new_width: int, key: str = "image") -> DataFrame:
    """Bicubic interpolation with half-pixel centres and clamped edges."""
    spark = grid.sparkSession
    return _weighted(grid, _cubic_taps(spark, "r", height, new_height), _cubic_taps(spark, "c", width, new_width), key)


def reflect_pad(grid: DataFrame, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """The grid with that many more rows and columns on each side, mirrored without repeating the edge."""
    if rows >= height or cols >= width or min(rows, cols) < 0:
        raise ValueError("padding must be smaller than the grid")

    def mirrored(name: str, size: int, pad: int) -> DataFrame:
        j = F.abs(F.col("id") - pad)
        back = F.when(j >= size, 2 * (size - 1) - j).otherwise(j)
        return grid.sparkSession.range(size + 2 * pad).select(F.col("id").cast("int").alias(f"n{name}"), back.cast("int").alias(name))

    out = grid.join(F.broadcast(mirrored("r", height, rows)), "r").join(F.broadcast(mirrored("c", width, cols)), "c")
    return out.drop("r", "c").withColumnsRenamed({"nr": "r", "nc": "c"})


def jitter(grid: DataFrame, height: int, width: int, pad_x: int, pad_y: int, zoom_x: float, zoom_y: float, rotate: float = 0.0, key: str = "image") -> DataFrame:
    """Mirrored padding (``pad_x`` columns, ``pad_y`` rows a side), then bilinear zoom: rows by ``zoom_x``, columns by ``zoom_y``.

    Sizes are rounded down, and source places follow the zoom given, not the rounded sizes. ``rotate`` is taken and left aside.
    """
    if pad_x or pad_y:
        grid, height, width = reflect_pad(grid, height, width, pad_y, pad_x), height + 2 * pad_y, width + 2 * pad_x
    if zoom_x == 1 and zoom_y == 1:
        return grid
    spark = grid.sparkSession
    rows, cols = _taps(spark, "r", height, int(height * zoom_x), 1 / zoom_x), _taps(spark, "c", width, int(width * zoom_y), 1 / zoom_y)
    return _weighted(grid, rows, cols, key)


def box_blur(grid: DataFrame, size: int = 5, key: str = "image") -> DataFrame:
    """Mean over size x size with zero padding counted, as two running sums."""
    half = size // 2
    by_row = W.partitionBy(key, "r").orderBy("c").rangeBetween(-half, half)
    by_col = W.partitionBy(key, "c").orderBy("r").rangeBetween(-half, half)
    return grid.withColumn("_s", F.sum("x").over(by_row)).withColumn("x", F.sum("_s").over(by_col) / (size * size)).drop("_s")


def patch_places(height: int, width: int, kernel: int) -> tuple[int, int]:
    """Places of a kernel that fit beside one another along each axis; a grid smaller than the kernel is an error."""
    if min(height, width) < kernel:
        raise ValueError("the grid must be at least as large as the kernel")
    return height // kernel, width // kernel


def unfold(grid: DataFrame, height: int, width: int, kernel: int, out: int | tuple[int, int]) -> DataFrame:
    """(image, pr, pc, kr, kc, x): patches of out x out (or rows, columns) places, stride (size - kernel) div (out - 1), or the kernel for one."""
    spark = grid.sparkSession

    def at(n: str, size: int, many: int) -> DataFrame:
        stride = (size - kernel) // (many - 1) if many > 1 else kernel
        p, k = F.floor(F.col("id") / kernel).cast("int"), (F.col("id") % kernel).cast("int")
        return spark.range(many * kernel).select(p.alias(f"p{n}"), k.alias(f"k{n}"), (p * stride + k).cast("int").alias(n))

    rows, cols = (out, out) if isinstance(out, int) else out
    return grid.join(F.broadcast(at("r", height, rows)), "r").join(F.broadcast(at("c", width, cols)), "c").drop("r", "c")


def attention_downsample(grid: DataFrame, height: int, width: int, kernel: int, linear: list[float], scale: list[float], bias: list[float], vector: str = "v", key: str = "image") -> DataFrame:
    """(image, pr, pc, v): vectors of each patch averaged with weights softmax(score * scale + bias) over its cells.

    The score of a cell is the dot product of its vector with ``linear``; ``scale`` and ``bias`` have a value for each
    cell of the kernel by rows. All zero in ``linear`` and ``bias`` is average pooling. A patch is one group of kernel
    * kernel cells, summed in partial aggregates by component.
    """
    if len(scale) != kernel * kernel or len(bias) != kernel * kernel:
        raise ValueError("scale and bias need a value for each cell of the kernel")
    cells = unfold(grid, height, width, kernel, patch_places(height, width, kernel))
    number = F.col("kr") * kernel + F.col("kc")
    pick = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), number)
    cells = cells.withColumn("_w", F.exp(dot(F.col(vector), F.array(*[F.lit(float(x)) for x in linear])) * pick(scale) + pick(bias)))
    total = cells.groupBy(key, "pr", "pc").agg(F.sum("_w").alias("_t"))
    parts = cells.select(key, "pr", "pc", "_w", F.posexplode(vector).alias("d", "x")).groupBy(key, "pr", "pc", "d").agg(F.sum(F.col("_w") * F.col("x")).alias("s"))
    return parts.join(total, [key, "pr", "pc"]).select(key, "pr", "pc", "d", (F.col("s") / F.col("_t")).alias("x"))


def total_variation(grid: DataFrame, key: str = "image") -> DataFrame:
    """(image, tv): squared forward differences of both axes over the number of pixels."""
    right = F.lead("x").over(W.partitionBy(key, "r").orderBy("c")) - F.col("x")
    down = F.lead("x").over(W.partitionBy(key, "c").orderBy("r")) - F.col("x")
    d = grid.withColumn("_r", right).withColumn("_d", down)
    total = F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0)) + F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0))
    return d.groupBy(key).agg((total / F.count("*")).alias("tv"))


def boundary(mask: DataFrame, height: int, width: int, key: str = "image", value: str = "m") -> DataFrame:
    """Adds ``edge``: a pixel differs from its east, south or south-east neighbour.

    The last row looks east only, the last column south only, the corner at nothing.
    """
    east = F.lead(value).over(W.partitionBy(key, "r").orderBy("c"))
    south = F.lead(value).over(W.partitionBy(key, "c").orderBy("r"))
    se = F.lead(value).over(W.partitionBy(key, F.col("c") - F.col("r")).orderBy("r"))
    m = F.col(value)
    differs = lambda x: F.coalesce(m != x, F.lit(False))
    edge = (
        F.when((F.col("r") == height - 1) & (F.col("c") == width - 1), False)
        .when(F.col("r") == height - 1, differs(east))
        .when(F.col("c") == width - 1, differs(south))
        .otherwise(differs(east) | differs(south) | differs(se))
    )
    return mask.withColumn("edge", edge)


def dilate(points: DataFrame, radius: int, key: str = "image") -> DataFrame:
    """(image, r, c) of all cells within a disk of the points; not clipped."""
    disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disk])
    moved = points.select(key, "r", "c", F.inline(offsets))
    return moved.select(key, (F.col("r") + F.col("a")).alias("r"), (F.col("c") + F.col("b")).alias("c")).distinct()


def run_lengths(mask: DataFrame, height: int, key: str = "image", value: str = "m") -> DataFrame:
    """(image, counts): column-major run lengths that alternate 0 and 1 and start with 0."""
    pos = F.col("c") * height + F.col("r")
    by = W.partitionBy(key).orderBy("pos")
    runs = mask.select(key, pos.alias("pos"), F.col(value).cast("int").alias("v")).withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(by)).cast("int"), F.lit(0)))
    runs = runs.withColumn("run", F.sum("new").over(by)).groupBy(key, "run").agg(F.first("v").alias("v"), F.count("*").alias("n"))
    lists = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run", "v", "n"))).alias("s"))
    counts = F.transform("s", lambda x: x["n"])
    return lists.select(key, F.when(F.get("s", F.lit(0))["v"] == 1, F.concat(F.array(F.lit(0).cast("bigint")), counts)).otherwise(counts).alias("counts"))


def decode_runs(rows: DataFrame, height: int, key: str = "image", counts: str = "counts") -> DataFrame:
    """(image, r, c) of the member pixels of run lengths."""
    ends = F.aggregate(F.col(counts), F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    runs = rows.select(key, F.col(counts).alias("_n"), ends.alias("_e")).select(key, "_e", F.posexplode("_n").alias("i", "n")).where("i % 2 = 1 and n > 0")
    start = F.get("_e", F.col("i"))
    pixels = runs.select(key, F.explode(F.sequence(start, start + F.col("n") - 1)).alias("pos"))
    return pixels.select(key, (F.col("pos") % height).cast("int").alias("r"), F.floor(F.col("pos") / height).cast("int").alias("c"))

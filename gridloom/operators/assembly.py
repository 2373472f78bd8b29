"""Putting records together: caps and padding, positional zips, prefixes, proposals and compressed run lengths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cap_and_pad(values: Column, width: int, fill: object = -1) -> Column:
    """The first ``width`` entries; missing slots hold ``fill``. A null array has all slots filled."""
    if width <= 0:
        raise ValueError("width must be positive")
    kept = F.slice(F.coalesce(values, F.array()), 1, width)
    return F.concat(kept, F.array_repeat(F.lit(fill), F.lit(width) - F.size(kept)))


def zip_positions(left: DataFrame, right: DataFrame, key: str, order: list[str], value: str, fill: object = -1) -> DataFrame:
    """(key, position, value) for each row of ``left``: the value at the same position of ``right``, else ``fill``."""
    by = W.partitionBy(key).orderBy(*order)
    numbered = lambda d: d.withColumn("position", F.row_number().over(by))
    return numbered(left).select(key, "position").join(numbered(right).select(key, "position", value), [key, "position"], "left").na.fill({value: fill})


def is_prefix(old: Column, new: Column) -> Column:
    """Whether the array ``old`` begins ``new``."""
    return F.slice(new, 1, F.greatest(F.size(old), F.lit(0))) == old


def with_prefix(rows: DataFrame, name: str, prefix: str) -> DataFrame:
    """Rows whose name starts with a prefix, which is cut off."""
    return rows.where(F.startswith(name, F.lit(prefix))).withColumn(name, F.substring(name, len(prefix) + 1, 1 << 30))


def repeat_row(rows: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times with its number ``i``; meant for one selected row."""
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Softmax cross entropy of one row: log of the sum of exponentials less the label's logit."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return top + F.log(total) - F.get(logits, label)


def interior(grid: DataFrame, height: int, width: int, border: float) -> DataFrame:
    """Rows from int(border * height) up to int((1 - border) * height), and columns likewise."""
    if not 0 <= border < 0.5:
        raise ValueError("border must lie in [0, 0.5)")
    inside = [F.col(c).between(int(border * n), int((1 - border) * n) - 1) for c, n in (("r", height), ("c", width))]
    return grid.where(inside[0] & inside[1])


def grid_proposals(grid: DataFrame, height: int, width: int, n: int) -> DataFrame:
    """``proposal`` of each pixel: tiles of a square grid numbered by rows from 1; beyond the n-th tile 0."""
    side = math.ceil(math.sqrt(n))
    # Tile k holds floor(k * size / side) up to floor((k + 1) * size / side).
    tile = lambda c, size: F.floor(((F.col(c) + 1) * side - 1) / size)
    number = (tile("r", height) * side + tile("c", width) + 1).cast("int")
    return grid.withColumn("proposal", F.when(number <= n, number).otherwise(0))


def relabel(rows: DataFrame, group: str, label: str, n: int, seed: int) -> DataFrame:
    """Labels 1 to n of each group permuted by hashed order; 0 stays."""
    names = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(F.sha2(F.concat_ws(":", F.lit(seed), F.col(group), k), 256).alias("h"), k.alias("k")))
    order = F.transform(F.array_sort(names), lambda x: x["k"])
    return rows.withColumn(label, F.array_position(order, F.col(label)).cast("int"))


def object_masks(frames: DataFrame, frame: str, label: str, void: int = 255, all_frames: bool = False) -> DataFrame:
    """A row for each pixel and object: ``truth`` of the object, ``void`` of the pixel.

    Objects are 1 to the greatest label of frame 0 (truth), or of all frames (predictions).
    """
    ids = F.when(F.col(label) == void, 0).otherwise(F.col(label))
    rows = frames.withColumn("void", F.col(label) == void).withColumn(label, ids)
    count = (rows if all_frames else rows.where(F.col(frame) == 0)).agg(F.coalesce(F.max(label), F.lit(0)).alias("_n"))
    rows = rows.crossJoin(F.broadcast(count)).where("_n > 0").withColumn("object", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return rows.withColumn("truth", F.col(label) == F.col("object")).drop("_n")


def counters(rows: DataFrame, group: str, value: str, order: list[str], last: int = 5) -> DataFrame:
    """(group, n, total, mean, positive, last ``value``s newest first); only ``last`` rows a group leave a task before the shuffle."""
    by = W.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    recent = rows.withColumn("k", F.row_number().over(by)).where(F.col("k") <= last).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda x: x[value]).alias("recent"))
    sums = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count_if(F.col(value) > 0).alias("positive"))
    return sums.join(recent, group)


def byte_alphabet(byte: Column) -> Column:
    """Code point that stands for a byte: printable ones stand for themselves, the k-th other one is 256 + k."""
    printable = byte.between(33, 126) | byte.between(161, 172) | byte.between(174, 255)
    others = F.when(byte <= 32, byte).when(byte <= 160, byte - 127 + 33).otherwise(byte - 173 + 67)
    return F.when(printable, byte).otherwise(others + 256)


def compress_counts(counts: Column) -> Column:
    """Run lengths as text: from the fourth on less the one two before, in groups of five bits, low first,
    each a character from code 48; bit 32 marks that more follow."""
    delta = F.transform(counts, lambda x, i: F.when(i > 2, x - F.get(counts, i - 2)).otherwise(x).cast("bigint"))

    def coded(x: Column) -> Column:
        # x fits in k groups when -2**(5k-1) <= x < 2**(5k-1).
        size = F.element_at(F.filter(F.sequence(F.lit(1), F.lit(12)), lambda k: (x >= -F.pow(2, 5 * k - 1)) & (x < F.pow(2, 5 * k - 1))), 1)
        one = lambda k: F.char(F.pmod(F.floor(x / F.pow(2, 5 * k)), F.lit(32)) + F.when(k < size - 1, 32).otherwise(0) + 48)
        return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), one), "")

    return F.array_join(F.transform(delta, coded), "")


def expand_counts(text: Column) -> Column:
    """The run lengths that ``compress_counts`` made a text of."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 48).cast("bigint"))
    state = "struct<out:array<bigint>,x:bigint,unit:bigint>"
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("x"), F.lit(1).cast("bigint").alias("unit")).cast(state)

    def step(a: Column, c: Column) -> Column:
        x = a["x"] + F.pmod(c, F.lit(32)) * a["unit"]
        more, signed = c >= 32, F.pmod(c, F.lit(32)) >= 16
        done = x - F.when(signed, a["unit"] * 32).otherwise(0)
        done = done + F.when(F.size(a["out"]) > 2, F.get(a["out"], F.size(a["out"]) - 2)).otherwise(0)
        unfinished = F.struct(a["out"].alias("out"), x.alias("x"), (a["unit"] * 32).alias("unit")).cast(state)
        finished = F.struct(F.concat(a["out"], F.array(done)).alias("out"), F.lit(0).cast("bigint").alias("x"), F.lit(1).cast("bigint").alias("unit")).cast(state)
        return F.when(more, unfinished).otherwise(finished)

    return F.aggregate(codes, start, step, lambda a: a["out"])

"""Scans of folders, list files and manifests as DataFrames; Spark lists and reads, so any store will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.splits import hash_hex

IMAGE_KINDS = ("jpg", "jpeg", "png")


def files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length) of the files of a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root).select("path", "length")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(path: Column) -> Column:
    """The path without its last extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def kind_of(path: Column) -> Column:
    """The last extension, in small letters."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def paired(paths: DataFrame, path: str = "path", image: str = "jpg", partner: str = "json") -> DataFrame:
    """(stem, path) of images whose partner of the same stem is there too: a semi-join."""
    rows = paths.select(F.col(path).alias("path"), stem_of(F.col(path)).alias("stem"), kind_of(F.col(path)).alias("kind"))
    return rows.where(F.col("kind") == image).join(rows.where(F.col("kind") == partner).select("stem").distinct(), "stem", "left_semi").select("stem", "path")


def split_pairs(pairs: DataFrame, split: str, sample_size: int = 1_000_000, val_fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """The train or val part of at most ``sample_size`` pairs in seeded hash order; val is the first min(n - 1, max(1, int(n * f))).

    The order depends on the stems' base names and the seed alone. Only a count reaches the driver: the prefix is a
    sorted take, so no window runs over all rows.
    """
    if split not in ("train", "val") or not 0 < val_fraction < 1 or sample_size < 2:
        raise ValueError("use split train or val, 0 < val_fraction < 1 and a sample of two or more")
    name = base_name(F.col("stem"))
    capped = pairs.withColumn("_o", F.struct(hash_hex(name, seed), name)).orderBy("_o").limit(sample_size)
    n = capped.count()
    if n < 2:
        raise ValueError("at least two pairs are needed for a split")
    first = capped.orderBy("_o").limit(min(n - 1, max(1, int(n * val_fraction))))
    return (first if split == "val" else capped.join(first.select("stem"), "stem", "left_anti")).drop("_o")


def from_lists(lists: DataFrame, root: str, dirs: Sequence[str]) -> DataFrame:
    """(split_dir, image, label) for each line (split_dir, value) of the list files of the given folders, in their union."""
    name = F.regexp_replace("value", r"\s+$", "")
    parts = [lists.where(F.col("split_dir") == d) for d in dirs]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    place = lambda kind, end: F.concat_ws("/", F.lit(root), F.lit(kind), "split_dir", F.concat(name, F.lit(end)))
    return rows.select("split_dir", place("images", ".jpg").alias("image"), place("annotations", ".png").alias("label"))


def list_scan(spark: SparkSession, root: str, split: str, list_file: str) -> DataFrame:
    """Images and labels by the list file of each folder of a split; "train+val" is both, in that order."""
    dirs = {"train": ["train2017"], "val": ["val2017"], "train+val": ["train2017", "val2017"]}
    if split not in dirs:
        raise ValueError(f"unknown split {split}")
    lines = None
    for d in dirs[split]:
        one = spark.read.text(f"{root}/curated/{d}/{list_file}").select(F.lit(d).alias("split_dir"), "value")
        lines = one if lines is None else lines.unionByName(one)
    return from_lists(lines, root, dirs[split])


def label_path(image: Column) -> Column:
    """The path of an image's labels: the other folder, the name up to the first dot, and the suffix."""
    return F.concat(F.get(F.split(F.replace(image, F.lit("leftImg8bit"), F.lit("gtFine")), r"\."), F.lit(0)), F.lit("_labelTrainIds.png"))


def city_scan(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(image, label) of leftImg8bit/<split>/<city>/*.png; "train+val" is both."""
    if split not in ("train", "val", "train+val"):
        raise ValueError(f"unknown split {split}")
    places = [f"{root}/leftImg8bit/{s}/*/*.png" for s in split.split("+")]
    return spark.read.format("binaryFile").load(places).select(F.col("path").alias("image"), label_path(F.col("path")).alias("label"))


def inventory(paths: DataFrame, member: str = r"^(sa_[0-9]+)\.(jpg|json)$") -> DataFrame:
    """(stem, parts): the sorted kinds of the non-empty files (path, length) whose base name fits."""
    base = base_name(F.col("path"))
    rows = paths.where(F.rlike(base, F.lit(member)) & (F.col("length") > 0))
    return rows.groupBy(F.regexp_extract(base, member, 1).alias("stem")).agg(F.array_sort(F.collect_set(F.regexp_extract(base, member, 2))).alias("parts"))


def preview(paths: DataFrame, most: int, kinds: Sequence[str] = IMAGE_KINDS) -> DataFrame:
    """The first ``most`` images by path: a sorted take."""
    return paths.where(kind_of(F.col("path")).isin(*kinds)).orderBy("path").limit(most)


def catalogue(sequences: DataFrame, images: DataFrame, masks: DataFrame, strict: bool = True) -> DataFrame:
    """(sequence, frame, image, mask) by the sorted frames (sequence, path) of the named sequences; missing masks are "-1".

    A sequence without images is an error where ``strict``.
    """
    by = W.partitionBy("sequence").orderBy("path")
    numbered = lambda d, name: d.select("sequence", (F.row_number().over(by) - 1).alias("frame"), F.col("path").alias(name))
    names = sequences.select(F.trim("sequence").alias("sequence"))
    rows = names.join(numbered(images, "image"), "sequence", "left").join(numbered(masks, "mask"), ["sequence", "frame"], "left")
    if strict:
        lost = F.raise_error(F.concat(F.lit("no images of the sequence "), F.col("sequence")))
        rows = rows.withColumn("image", F.when(F.col("image").isNull(), lost.cast("string")).otherwise(F.col("image")))
    return rows.withColumn("mask", F.coalesce("mask", F.lit("-1")))


def video_catalogue(spark: SparkSession, root: str, task: str = "unsupervised", subset: str = "val", resolution: str = "480p") -> DataFrame:
    """The catalogue of a video data set's folder: list file, frames and masks of the task."""
    subsets, tasks = ("train", "val", "test-dev", "test-challenge"), ("semi-supervised", "unsupervised")
    if subset not in subsets or task not in tasks:
        raise ValueError(f"use a subset of {subsets} and a task of {tasks}")
    year = "2019" if task == "unsupervised" and subset.startswith("test") else "2017"
    labels = "Annotations" if task == "semi-supervised" else "Annotations_unsupervised"
    frames = lambda kind, end: files(spark, f"{root}/{kind}/{resolution}", f"*.{end}", True).select(F.element_at(F.split("path", "/"), -2).alias("sequence"), "path")
    names = spark.read.text(f"{root}/ImageSets/{year}/{subset}.txt").select(F.col("value").alias("sequence"))
    return catalogue(names, frames("JPEGImages", "jpg"), frames(labels, "png"))


def palette_text(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(``keep``, red, green, blue) of lines of three integers."""
    part = F.transform(F.split(F.regexp_replace(value, r"^\s+|\s+$", ""), r"\s+"), lambda x: x.cast("int"))
    return lines.select(*keep, *[F.get(part, F.lit(k)).alias(n) for k, n in enumerate(("red", "green", "blue"))])


def manifest(lines: DataFrame, value: str = "value", line: str = "line") -> DataFrame:
    """(file_name, cdn_link, line) of the lines (value, line) of a tab-separated file with a header as the smallest line.

    A byte-order mark, blanks around values, other columns and other files than .tar are left out; of a name that
    comes twice the first counts. Missing columns, an address that is not http(s), or no archive are errors.
    """
    cells = lambda c: F.split(F.regexp_replace(c, "^\ufeff|\r$", ""), "\t")
    first = lines.orderBy(line).limit(1).select(cells(F.col(value)).alias("h"), F.col(line).alias("header_line")).collect()
    head = first[0]["h"] if first else []
    if not {"file_name", "cdn_link"} <= set(head):
        raise ValueError("the manifest needs the columns file_name and cdn_link")
    row = lines.where(F.col(line) > first[0]["header_line"]).select(cells(F.col(value)).alias("c"), F.col(line).alias("line"))
    cell = lambda n: F.trim(F.coalesce(F.get("c", F.lit(head.index(n))), F.lit("")))
    named = row.select(cell("file_name").alias("file_name"), cell("cdn_link").alias("cdn_link"), "line").where(F.endswith("file_name", F.lit(".tar")))
    bad = F.raise_error(F.concat(F.lit("invalid archive entry: "), F.col("file_name"))).cast("string")
    named = named.withColumn("cdn_link", F.when(F.rlike("cdn_link", F.lit("^https?://")), F.col("cdn_link")).otherwise(bad))
    out = named.groupBy("file_name").agg(F.min_by("cdn_link", "line").alias("cdn_link"), F.min("line").alias("line"))
    if out.isEmpty():
        raise ValueError("the manifest holds no archives")
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``manifest`` of a file; it is read as one text, since its lines need their numbers."""
    whole = spark.read.text(path, wholetext=True)
    return manifest(whole.select(F.posexplode(F.split("value", "\n")).alias("line", "value")))


def legacy_skip(keys: DataFrame, count: int, key: str = "key") -> DataFrame:
    """The first ``count`` distinct keys by their integer suffix: what a cursor of sorted ids had committed. Fewer keys are an error."""
    first = keys.select(key).distinct().orderBy(F.regexp_extract(key, "([0-9]+)$", 1).cast("bigint"), key).limit(count)
    if first.count() < count:
        raise ValueError("the source has fewer pairs than the cursor says")
    return first


def resumed(pairs: DataFrame, source: int, cursor: tuple[int, int], skip: DataFrame | None = None, key: str = "key", completed: str = "n") -> DataFrame:
    """Pairs of the sources (``source`` numbers the rows' own) that a cursor (source, completions) leaves, less ``skip``."""
    left = pairs.where((F.col("source") > cursor[0]) | ((F.col("source") == cursor[0]) & (F.col(completed) > cursor[1])))
    return left if skip is None else left.where(F.col("source") != source).unionByName(left.where(F.col("source") == source).join(skip.select(key), key, "left_anti"))

"""Indexed images as rows of labels: PNG files of one channel, found and read by Spark, decoded in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: the first bytes of a file, and the colour types of one channel.
SIGNATURE, GREY, INDEXED = b"\x89PNG\r\n\x1a\n", 0, 3
#: Fixed value: the label of pixels that count for nothing.
VOID = 255
#: A private chunk that other readers pass over: a packed bit a pixel, set where a frame has none.
HOLES = b"hoLE"


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of a file's chunks; a wrong signature, checksum, length or end is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("the file ends inside a chunk")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise ValueError("the file ends inside a chunk")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind.decode('latin-1')}")
        yield kind, body
        at += 12 + size


def unfiltered(raw: np.ndarray) -> np.ndarray:
    """Scan lines of one byte a step, each with its filter's number in front, without their filters."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for k, line in enumerate(raw):
        rule, x = int(line[0]), line[1:]
        if rule == 0:
            row = x
        elif rule == 1:
            row = np.cumsum(x, dtype=np.uint64).astype(np.uint8)
        elif rule == 2:
            row = x + above
        elif rule in (3, 4):
            # Each byte needs the one before it, so these two go byte by byte.
            row, left, corner = np.empty_like(x), 0, 0
            for i, (v, up) in enumerate(zip(x.tolist(), above.tolist(), strict=True)):
                if rule == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = left if a <= b and a <= c else up if b <= c else corner
                left, corner = (v + guess) & 255, up
                row[i] = left
        else:
            raise ValueError(f"no filter has the number {rule}")
        out[k] = above = row
    return out


def decoded(data: bytes) -> tuple[np.ndarray, bytes, int]:
    """The labels of an image of one channel, its palette (three bytes an entry, empty if it has none), and its bit depth."""
    header, palette, packed = None, b"", []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            packed.append(body)
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = header
    if colour not in (GREY, INDEXED) or depth not in (1, 2, 4, 8) or interlaced:
        raise ValueError(f"no plain image of labels: colour type {colour}, {depth} bits, interlaced {interlaced}")
    if colour == INDEXED and not palette:
        raise ValueError("an indexed image needs a palette")
    stride = -(-width * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (stride + 1):
        raise ValueError("too few or too many pixels")
    lines = unfiltered(raw.reshape(height, stride + 1))
    if depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(height, width, depth)
        lines = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8)
    return lines, palette, depth


def holes_of(data: bytes, height: int, width: int) -> np.ndarray | None:
    """A mask of the pixels that the image's frame does not have; None if it has all."""
    packed = b"".join(body for kind, body in chunks(data) if kind == HOLES)
    if not packed:
        return None
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
    if len(bits) // 8 != -(-height * width // 8):
        raise ValueError("too few or too many marks of holes")
    return bits[: height * width].reshape(height, width).astype(bool)


def encoded(labels: np.ndarray, palette: bytes, depth: int = 8, rule: int | None = None, holes: np.ndarray | None = None) -> bytes:
    """An indexed image of a two-dimensional array of labels; ``rule`` is the filter of all lines, by default 0 to 4 in turn; ``holes`` marks pixels that are none."""
    if labels.ndim != 2 or labels.size == 0:
        raise ValueError("an image of labels has two dimensions and pixels")
    if depth not in (1, 2, 4, 8) or labels.min() < 0 or labels.max() >= 1 << depth:
        raise ValueError(f"labels do not fit in {depth} bits")
    height, width = labels.shape
    x = labels.astype(np.uint8)
    if depth < 8:
        x = np.packbits(((x[:, :, None] >> np.arange(depth - 1, -1, -1, dtype=np.uint8)) & 1).reshape(height, -1), axis=1)
    wide = x.astype(np.int16)
    left, up = np.pad(wide, ((0, 0), (1, 0)))[:, :-1], np.pad(wide, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(wide, ((1, 0), (1, 0)))[:-1, :-1]
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    guesses = (np.zeros_like(wide), left, up, (left + up) >> 1, paeth)
    rules = np.arange(height) % 5 if rule is None else np.full(height, rule)
    lines = np.stack([np.concatenate(([r], (wide[k] - guesses[r][k]) & 255)) for k, r in enumerate(rules.tolist())]).astype(np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, depth, INDEXED, 0, 0, 0)
    gaps = b"" if holes is None else chunk(HOLES, zlib.compress(np.packbits(holes).tobytes()))
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"PLTE", palette) + gaps + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_label_images(pixels: DataFrame, folder: str, palette: bytes, depth: int = 8, size: tuple[int, int] | None = None) -> DataFrame:
    """Write (sequence, frame, r, c, label) as folder/sequence/frame.png, an image a frame; gives (sequence, frame, bytes).

    A frame is one group, as an image is one file. Pixels must fill a rectangle from (0, 0), unless ``size``, (height, width),
    says how large all images are: pixels that a frame lacks are holes then, and come back as none. Files appear whole under their names.
    """
    from gridloom.sources.stores import write_bytes

    def run(table: pa.Table) -> pa.Table:
        r, c, x = (table[k].to_numpy() for k in ("r", "c", "label"))
        sequence, frame = table["sequence"][0].as_py(), table["frame"][0].as_py()
        height, width = size or (int(r.max()) + 1, int(c.max()) + 1)
        if min(r.min(), c.min()) < 0 or r.max() >= height or c.max() >= width:
            raise ValueError(f"{sequence}/{frame}: pixels outside of {height} x {width}")
        image = np.full((height, width), -1, np.int64)
        image[r, c] = x
        holes = image < 0
        if image.size - holes.sum() != len(r) or (size is None and holes.any()):
            raise ValueError(f"{sequence}/{frame}: pixels are missing or come twice")
        data = encoded(np.where(holes, 0, image), palette, depth, holes=holes if holes.any() else None)
        write_bytes(f"{folder}/{sequence}/{frame}.png", data)
        return pa.table({"sequence": [sequence], "frame": [frame], "bytes": pa.array([len(data)], pa.int64())})

    rows = pixels.select(F.col("sequence").cast("string"), F.col("frame").cast("string"), F.col("r").cast("int"), F.col("c").cast("int"), F.col("label").cast("int"))
    return rows.groupBy("sequence", "frame").applyInArrow(run, "sequence string, frame string, bytes bigint")


def label_images(spark: SparkSession, folder: str, sequences: list[str] | None = None) -> DataFrame:
    """(sequence, frame, height, width, depth, colours, labels, holes) of folder/sequence/frame.png; labels are all pixels by rows, as bytes.

    So are holes, 1 where the frame has no pixel, null if it has all.

    Spark lists and reads the files, from any store, so a broken file fails the task that holds it and says which it is.
    ``sequences`` are the folders to read, by default all.
    """
    paths = [f"{folder}/{s}/*.png" for s in sequences] if sequences else [f"{folder}/*/*.png"]
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    data = content.as_py()
                    image, palette, depth = decoded(data)
                    holes = holes_of(data, *image.shape)
                except (ValueError, zlib.error, struct.error) as error:
                    raise ValueError(f"{path}: {error}") from error
                sequence, name = path.split("/")[-2:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sequence]), pa.array([name.removesuffix(".png")]), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([depth], pa.int32()), pa.array([len(palette) // 3], pa.int32()), pa.array([image.tobytes()], pa.binary()), pa.array([None if holes is None else holes.tobytes()], pa.binary())],
                    names=["sequence", "frame", "height", "width", "depth", "colours", "labels", "holes"],
                )

    return files.mapInArrow(run, "sequence string, frame string, height int, width int, depth int, colours int, labels binary, holes binary")


def pixels_of(images: DataFrame) -> DataFrame:
    """(sequence, frame, r, c, label) of images of labels, by expressions; holes give no rows."""
    rows = images.select("sequence", "frame", "width", F.hex("labels").alias("h"), F.hex("holes").alias("o"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r"))
    # A line at a time, two hex digits a pixel, so that no image is exploded from one long array.
    line = lambda h: F.regexp_extract_all(F.substr(h, F.col("r") * F.col("width") * 2 + 1, F.col("width") * 2), F.lit(".."), F.lit(0))
    held = F.when(F.col("o").isNull(), line("h")).otherwise(F.zip_with(line("h"), line("o"), lambda x, o: F.when(o == "00", x)))
    cut = rows.select("sequence", "frame", "r", F.posexplode(held).alias("c", "x")).where("x is not null")
    return cut.select("sequence", "frame", "r", "c", F.conv("x", 16, 10).cast("int").alias("label"))


def object_masks(pixels: DataFrame, void: int = VOID) -> DataFrame:
    """(sequence, frame, r, c, object, is_void): void pixels belong to no object; object 0 is the ground."""
    is_void: Column = F.col("label") == void
    return pixels.select("sequence", "frame", "r", "c", F.when(is_void, 0).otherwise(F.col("label")).cast("int").alias("object"), is_void.alias("is_void"))


def read_results(spark: SparkSession, folder: str, truth: DataFrame) -> DataFrame:
    """(sequence, frame, r, c, label) of predictions for the frames (sequence, frame) of ``truth``; frames without a file, or of another size, are an error.

    The size of a sequence is that of its first predicted frame.
    """
    images = label_images(spark, folder)
    wanted = truth.select("sequence", "frame").distinct()
    missing = wanted.join(images.select("sequence", "frame"), ["sequence", "frame"], "left_anti").orderBy("sequence", "frame").limit(5).collect()
    if missing:
        raise ValueError("no prediction for " + ", ".join(f"{m['sequence']}/{m['frame']}" for m in missing))
    found = images.join(wanted, ["sequence", "frame"], "left_semi")
    sizes = found.groupBy("sequence").agg(F.count_distinct("height", "width").alias("n")).where("n > 1").orderBy("sequence").limit(5).collect()
    if sizes:
        raise ValueError("frames of several sizes in " + ", ".join(s["sequence"] for s in sizes))
    return pixels_of(found)


def first_segmentation(images: DataFrame, factor: int, size: tuple[int, int] | None = None) -> DataFrame:
    """(sequence, r, c, soft): the first frame of every sequence by nearest neighbour at size / factor, its labels one-hot.

    ``size`` is (height, width); by default the shorter side becomes 224 and the longer keeps its share, down to a multiple of
    ``factor``. Labels 0 to the sequence's greatest are the classes. A new pixel whose source is a hole is none.
    """
    first = images.groupBy("sequence").agg(F.min_by(F.struct("height", "width", "labels", "holes"), "frame").alias("i")).select("sequence", "i.*")
    scaled = lambda a, b: F.floor(F.floor(F.lit(224.0) * a / b / factor) * factor).cast("int")
    h, w = F.col("height"), F.col("width")
    if size is None:
        new_h, new_w = F.when(w > h, F.lit(224)).otherwise(scaled(h, w)), F.when(w > h, scaled(w, h)).otherwise(F.lit(224))
    else:
        new_h, new_w = F.lit(size[0]), F.lit(size[1])
    small = first.select("sequence", "height", "width", F.floor(new_h / factor).cast("int").alias("nh"), F.floor(new_w / factor).cast("int").alias("nw"), F.hex("labels").alias("x"), F.hex("holes").alias("o"))
    lines = small.select("*", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("r"))
    cells = lines.select("*", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)).alias("c"))
    # The source is the pixel under the centre of the new one.
    from_r, from_c = F.floor((F.col("r") + 0.5) * h / F.col("nh")), F.floor((F.col("c") + 0.5) * w / F.col("nw"))
    source = lambda h: F.substr(h, ((from_r * w + from_c) * 2 + 1).cast("int"), F.lit(2))
    labelled = cells.where(F.col("o").isNull() | (source("o") == "00")).select("sequence", "r", "c", F.conv(source("x"), 16, 10).cast("int").alias("label"))
    most = labelled.groupBy(F.col("sequence").alias("of")).agg(F.max("label").alias("most"))
    soft = F.transform(F.sequence(F.lit(0), F.col("most")), lambda k: (k == F.col("label")).cast("double"))
    return labelled.join(most, F.col("sequence") == F.col("of")).select("sequence", "r", "c", soft.alias("soft"))

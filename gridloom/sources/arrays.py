"""Archives of named arrays (.npz) as a data source: rows of several arrays side by side, split into ranges of rows."""

from __future__ import annotations

import ast
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.stores import store

#: Fixed values of the formats: marks of the end of the directory (and its long form), of an entry and of a file, and of an array.
END, LONG_END, LONG_PLACE, ENTRY, MAGIC = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"\x93NUMPY"
STORED, DEFLATED = 0, 8


def directory(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Name to (method, packed size, size, place of the entry's head) by the archive's directory, which is all that is read."""
    tail = min(size, (1 << 16) + 22 + 20)
    file.seek(size - tail)
    data = file.read(tail)
    at = data.rfind(END)
    if at < 0:
        raise ValueError("no archive: it has no directory")
    _, count, length, start = struct.unpack_from("<HHII", data, at + 8)
    if count == 0xFFFF or start == 0xFFFFFFFF or length == 0xFFFFFFFF:
        near = data.rfind(LONG_PLACE, 0, at)
        if near < 0:
            raise ValueError("the long directory is missing")
        (place,) = struct.unpack_from("<Q", data, near + 8)
        file.seek(place)
        head = file.read(56)
        if head[:4] != LONG_END:
            raise ValueError("the long directory is broken")
        count, length, start = struct.unpack_from("<QQQ", head, 32)
    file.seek(start)
    table, at, out = file.read(length), 0, {}
    for _ in range(count):
        if table[at : at + 4] != ENTRY:
            raise ValueError("the directory is broken")
        method, _, _, _, packed, full, n, extra, note = struct.unpack_from("<HHHIIIHHH", table, at + 10)
        (place,) = struct.unpack_from("<I", table, at + 42)
        name = table[at + 46 : at + 46 + n].decode()
        # Sizes and places over four bytes stand in a field of their own, in this order, those that are needed only.
        field = table[at + 46 + n : at + 46 + n + extra]
        while len(field) >= 4:
            kind, size_ = struct.unpack_from("<HH", field)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{size_ // 8}Q", field, 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                place = next(values) if place == 0xFFFFFFFF else place
            field = field[4 + size_ :]
        out[name.removesuffix(".npy")] = (method, packed, full, place)
        at += 46 + n + extra + note
    return out


def array_header(stream) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and the header's length of an array; one in column order, or of Python objects, is an error."""
    head = stream.read(8)
    if head[:6] != MAGIC:
        raise ValueError("no array")
    wide = head[6] > 1
    (length,) = struct.unpack("<I" if wide else "<H", stream.read(4 if wide else 2))
    spec = ast.literal_eval(stream.read(length).decode("utf-8" if head[6] > 2 else "latin-1"))
    kind = np.dtype(spec["descr"])
    if kind.hasobject or kind.fields or (spec["fortran_order"] and len(spec["shape"]) > 1):
        raise ValueError("arrays of plain numbers in row order only")
    return kind, tuple(spec["shape"]), 8 + (4 if wide else 2) + length


class Inflated(io.RawIOBase):
    """An entry's bytes from its packed ones, forwards only; skipping costs the unpacking and no memory."""

    def __init__(self, file, packed: int):
        self.file, self.left, self.unpack, self.held = file, packed, zlib.decompressobj(-15), b""

    def read(self, n: int = -1) -> bytes:
        out = []
        while n:
            if not self.held:
                data = self.unpack.unconsumed_tail or self.file.read(min(self.left, 1 << 20))
                if not self.unpack.unconsumed_tail:
                    self.left -= len(data)
                self.held = self.unpack.decompress(data, 1 << 20)
                if not self.held and not data:
                    break
            out.append(self.held[:n])
            self.held = self.held[len(out[-1]) :]
            n -= len(out[-1])
        return b"".join(out)


class ArrayFile:
    """One array of an archive: its type and shape, and its rows by ranges."""

    def __init__(self, path: str, name: str):
        self.path, self.name = path, name
        system, place = store(path)
        self.file = system.open_input_file(place)
        found = directory(self.file, self.file.size())
        if name not in found:
            raise ValueError(f"{path} has no array {name}")
        self.method, self.packed, self.size, at = found[name]
        if self.method not in (STORED, DEFLATED):
            raise ValueError(f"{path}: array {name} is packed in another way")
        self.file.seek(at + 26)
        n, extra = struct.unpack("<HH", self.file.read(4))
        self.start = at + 30 + n + extra
        self.kind, self.shape, self.header = array_header(self.open())
        if not self.shape:
            raise ValueError(f"{path}: array {name} has no rows")
        self.row = int(np.prod(self.shape[1:], dtype=np.int64)) * self.kind.itemsize

    def open(self):
        self.file.seek(self.start)
        return self.file if self.method == STORED else Inflated(self.file, self.packed)

    def rows(self, begin: int, end: int, most: int) -> Iterator[np.ndarray]:
        """Rows begin to end in pieces of ``most``, flat: a stored array is read at its place, a packed one is unpacked up to it."""
        stream = self.open()
        skip = self.header + begin * self.row
        if self.method == STORED:
            stream.seek(self.start + skip)
        while self.method != STORED and skip:
            skip -= len(stream.read(min(skip, 1 << 20)))
        for at in range(begin, end, most):
            n = min(most, end - at)
            data = stream.read(n * self.row)
            if len(data) != n * self.row:
                raise ValueError(f"{self.path}: array {self.name} ends early")
            yield np.frombuffer(data, self.kind).reshape(n, -1)


def field_of(array: ArrayFile) -> str:
    """The column type of an array's rows: a number, or a flat array of numbers."""
    one = {"f": {2: "float", 4: "float", 8: "double"}, "i": {1: "tinyint", 2: "smallint", 4: "int", 8: "bigint"}, "u": {1: "smallint", 2: "int", 4: "bigint"}, "b": {1: "boolean"}}.get(array.kind.kind, {}).get(array.kind.itemsize)
    if one is None:
        raise ValueError(f"no column type for {array.kind}")
    return one if len(array.shape) == 1 else f"array<{one}>"


class Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str], rows: int):
        self.path, self.names, self.rows = options["path"], names, rows
        self.each = int(options.get("rows_per_partition", 65_536))
        if self.each < 1:
            raise ValueError("a partition has at least one row")

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.each, self.rows)) for a in range(0, self.rows, self.each)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        arrays = [ArrayFile(self.path, n) for n in self.names]
        most = max(1, min(8192, (8 << 20) // max(1, sum(a.row for a in arrays))))
        at = partition.begin
        for parts in zip(*(a.rows(partition.begin, partition.end, most) for a in arrays), strict=True):
            columns = [pa.array(np.arange(at, at + len(parts[0])), pa.int64())]
            for array, x in zip(arrays, parts, strict=True):
                x = x.astype({2: np.float32}.get(x.dtype.itemsize, x.dtype) if x.dtype.kind == "f" else x.dtype.newbyteorder("="))
                if x.dtype.kind == "u":
                    x = x.astype({1: np.int16, 2: np.int32, 4: np.int64}[x.dtype.itemsize])
                flat = pa.array(x.ravel())
                columns.append(flat if len(array.shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat))
            at += len(parts[0])
            yield pa.RecordBatch.from_arrays(columns, names=["row", *self.names])


class ArraySource(DataSource):
    """spark.dataSource.register(ArraySource); spark.read.format("npz").option("arrays", "feats,labels").load(file).

    Gives the place of each row and a column for each array; all must have as many rows. Options: arrays (by default feats,labels),
    num_limit (the first rows only), rows_per_partition. Only the archive's directory and the arrays' headers are read to plan.
    """

    @classmethod
    def name(cls):
        return "npz"

    def files(self) -> list[ArrayFile]:
        names = [n.strip() for n in self.options.get("arrays", "feats,labels").split(",")]
        return [ArrayFile(self.options["path"], n) for n in names]

    def schema(self):
        return "row bigint, " + ", ".join(f"`{a.name}` {field_of(a)}" for a in self.files())

    def reader(self, schema):
        arrays = self.files()
        if len({a.shape[0] for a in arrays}) > 1:
            raise ValueError("arrays of several lengths: " + ", ".join(f"{a.name} {a.shape[0]}" for a in arrays))
        rows = arrays[0].shape[0]
        limit = self.options.get("num_limit")
        return ArrayReader(self.options, [a.name for a in arrays], rows if limit is None else min(rows, int(limit)))

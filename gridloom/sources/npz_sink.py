"""Archives of arrays written from rows: every task writes its part of each array, the parts are strung together in order."""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridloom.sources.stores import move, remove, store

#: Bytes copied at a time.
PIECE = 8 << 20


def write_arrays(rows: DataFrame, path: str, order: list[str], kinds: dict[str, str]) -> int:
    """Write columns as the arrays of a stored archive, in the order of ``order``, and return the number of rows.

    ``kinds`` gives each column's number type. Rows are range-sorted and each task writes its parts to files of its own; the driver
    then streams them into the archive by pieces, and holds one row a task. All rows of a column must have one width, no nulls.
    The archive appears whole under its name. Parts of a task that ran twice are told apart by name.
    """
    work = f"{path}.parts-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = store(f"{work}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}")
        system.create_dir(folder, recursive=True)
        out = {name: system.open_output_stream(f"{folder}/{name}") for name in kinds}
        n, widths, sums = 0, dict.fromkeys(kinds, -1), dict.fromkeys(kinds, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            for name, kind in kinds.items():
                column = batch.column(batch.schema.names.index(name))
                flat = pa.types.is_list(column.type)
                values = column.flatten() if flat else column
                if column.null_count or values.null_count:
                    raise ValueError(f"{name} has nulls")
                wide = len(values) // batch.num_rows if flat else 0
                if flat and (np.diff(column.offsets.to_numpy()) != wide).any() or widths[name] not in (-1, wide):
                    raise ValueError(f"{name} has rows of several widths")
                widths[name] = wide
                data = values.to_numpy(zero_copy_only=False).astype(kind).tobytes()
                sums[name] = zlib.crc32(data, sums[name])
                out[name].write(data)
            n += batch.num_rows
        for stream in out.values():
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([folder]), pa.array([n], pa.int64()), pa.array([[widths[k] for k in kinds]], pa.list_(pa.int64()))], names=["part", "folder", "n", "widths"])

    try:
        sorted_ = rows.select(*dict.fromkeys([*order, *kinds])).repartitionByRange(*order).sortWithinPartitions(*order).select(*kinds)
        parts = sorted([r for r in sorted_.mapInArrow(run, "part int, folder string, n bigint, widths array<bigint>").collect() if r["n"]], key=lambda r: r["part"])
        total = sum(r["n"] for r in parts)
        widths = {k: {r["widths"][i] for r in parts} for i, k in enumerate(kinds)}
        if wrong := [k for k, w in widths.items() if len(w) > 1]:
            raise ValueError(f"{wrong[0]} has rows of several widths")
        system, place = store(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{place}.part") as out:
            _string(out, system, parts, {k: (np.dtype(kind), (total, *([] if not (w := next(iter(widths[k]), 0)) else [w]))) for k, kind in kinds.items()})
        move(f"{path}.part", path)
    finally:
        remove(work)
    return total


def _string(out, system, parts: list, arrays: dict[str, tuple[np.dtype, tuple[int, ...]]]) -> None:
    """The archive's entries from the parts' files, each with its checksum after it, and the directory, all in the long form."""
    at, table = 0, []
    for name, (kind, shape) in arrays.items():
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": shape})
        title = f"{name}.npy".encode()
        long = struct.pack("<HHQQ", 1, 16, 0, 0)
        local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(title), len(long)) + title + long
        out.write(local)
        check, size = zlib.crc32(head.getvalue()), head.tell()
        out.write(head.getvalue())
        for part in parts:
            with system.open_input_stream(f"{part['folder']}/{name}") as stream:
                while data := stream.read(PIECE):
                    check, size = zlib.crc32(data, check), size + len(data)
                    out.write(data)
        after = b"PK\x07\x08" + struct.pack("<IQQ", check, size, size)
        out.write(after)
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
        table.append(b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 33, check, 0xFFFFFFFF, 0xFFFFFFFF, len(title), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + title + extra)
        at += len(local) + size + len(after)
    packed = b"".join(table)
    out.write(packed)
    end = at + len(packed)
    out.write(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(table), len(table), len(packed), at))
    out.write(b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1))
    out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))

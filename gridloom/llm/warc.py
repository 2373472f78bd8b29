"""WARC archives in Zstandard: one frame a record after a leading skippable frame with the dictionary.

Archives are rows (archive, content), so that any store Spark writes to can hold them;
the reader takes such rows, or files through Spark's binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, type_of

#: Fixed values of the formats: the skippable frame of a dictionary, and a zstd frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Payload bytes in an archive (a larger page has one of its own), and the sample a dictionary is made from.
ARCHIVE, SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY = 16 << 20, 400, 2048, 16384
_ID = "urn:page:"


def sha1_base32(payload: bytes) -> str:
    """The digest form that archives use, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record: a response with an HTTP block, or a revisit that keeps only its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes], samples: list[bytes], level: int = 3) -> bytes:
    """A dictionary frame and one frame a record; too few samples for a dictionary give a raw-content one."""
    import zstandard

    try:
        data = zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        data = b"".join(samples)[:DICTIONARY].ljust(16, b" ")
    own = zstandard.ZstdCompressionDict(data)
    packed = zstandard.ZstdCompressor(level=level).compress(data)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True, write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed + b"".join(map(compressor.compress, records))


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record; ValueError where a header, a length or a digest is wrong."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.strip()] = value.strip()
    if missing := [h for h in REQUIRED if h not in headers]:
        raise ValueError(f"missing headers {missing}")
    if not headers["Content-Length"].isdigit():
        raise ValueError("bad Content-Length")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block_head, mark, payload = rest[:length].partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^Content-Length: *([0-9]+)\r?$", block_head)
    if not mark or not stated:
        raise ValueError("no HTTP header in the block")
    kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(stated[1]) or sha1_base32(payload) != digest):
        raise ValueError("the payload's length or digest is not the stated one")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in headers):
        raise ValueError("a revisit has a payload or refers to nothing")
    return {"headers": headers, "payload": payload, "payload_bytes": int(stated[1]), "digest": digest}


def read_archive(content: bytes) -> Iterator[dict]:
    """Records of an archive, one frame after the other."""
    import zstandard

    if len(content) < 8 or struct.unpack_from("<I", content)[0] != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack_from("<I", content, 4)[0]
    data = content[8 : 8 + size]
    if len(data) != size:
        raise ValueError("the dictionary frame is cut short")
    if data[:4] == FRAME_MAGIC:
        data = zstandard.ZstdDecompressor().decompress(data)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    at, view = 8 + size, memoryview(content)
    while at < len(content):
        # A frame's end is known only once it is decoded, so the input is fed in windows.
        frame, parts, fed = reader.decompressobj(), [], at
        while not frame.eof:
            if fed >= len(content):
                raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(view[fed : fed + 65536]))
            fed = min(fed + 65536, len(content))
        at = fed - len(frame.unused_data)
        yield parse_record(b"".join(parts))


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Adds _first (the response's id, of revisits only) and _revisit.

    Equal payloads of at least ``least`` bytes: the smallest id is the response. Rows without an id are responses.
    Only ids and digests meet by digest, so a page that many urls share moves no payloads to one task: the
    payloads are joined with the ids that revisit, by id and digest.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("_sha", F.sha2(payload, 256))
    long = rows.where((F.octet_length(payload) >= least) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col("_sha").alias("_digest"))
    firsts = long.groupBy(F.col("_digest").alias("_shared")).agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first <> _last").drop("_last")
    again = long.join(firsts, F.col("_digest") == F.col("_shared")).where("_id <> _first").select("_id", "_digest", "_first").distinct()
    joined = rows.join(again, (F.col(id_col) == F.col("_id")) & (F.col("_sha") == F.col("_digest")), "left")
    return joined.withColumn("_revisit", F.col("_first").isNotNull()).drop("_sha", "_id", "_digest")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(archive, n_records, content): a record of every row; null payloads are empty, null urls about:blank.

    The dictionary comes from the first SAMPLE_PAGES records of an archive, SAMPLE_BYTES of each: a bounded sample that affects sizes only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches_of(batches, ARCHIVE, 2)):
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            records = [record(i, url, html or b"", first, again, date) for i, url, html, first, again in rows]
            content = build_archive(records, [r[:SAMPLE_BYTES] for r in records[:SAMPLE_PAGES]])
            yield pa.RecordBatch.from_arrays([pa.array([f"pages-{task:05d}-{k:05d}.warc.zst"]), pa.array([len(records)], pa.int64()), pa.array([content], pa.binary())], names=["archive", "n_records", "content"])

    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = with_revisits(pages.select(F.col(id_col), F.col(url_col), F.col(payload_col)), id_col, payload_col, least)
    return rows.select(id_col, url_col, payload.alias("_payload"), "_first", "_revisit").mapInArrow(run, "archive string, n_records bigint, content binary")


def read_archives(archives: DataFrame, content_col: str = "content", id_col: str = "page_id", id_type: str = "bigint") -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record, validated.

    A broken archive raises an error. No rows give no rows. The payload of a revisit is null.
    """

    def number(uri: str | None):
        text = (uri or "").strip("<>").removeprefix(_ID)
        return (text if id_type == "string" else int(text)) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for r in read_archive(content.as_py()):
                    h = r["headers"]
                    again = h["WARC-Type"] == "revisit"
                    rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), None if again else r["payload"], r["payload_bytes"], r["digest"], h["WARC-Type"], number(h.get("WARC-Refers-To"))))
                    held += len(r["payload"])
                    if held > 4 << 20:
                        yield pack(rows, kind)
                        rows, held = [], 0
                if rows:
                    yield pack(rows, kind)

    def pack(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), kind]
        names = [id_col, "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return archives.select(content_col).mapInArrow(
        run, f"`{id_col}` {id_type}, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}"
    )

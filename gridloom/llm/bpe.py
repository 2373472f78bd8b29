"""Byte-level BPE with the tiktoken library and a local rank file.

The rank file's bytes travel in the task's closure (under 1 MB), so executors need no file.
Texts are cut only where the pattern must end a match: before white space that follows
other characters. No match runs from one to the other, and the pattern looks ahead only
inside white space, so pieces encode as the whole text would.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import batches_of, type_of

#: Longest piece given to the library at once, where a safe boundary allows.
PIECE = 1 << 16
_SAFE = regex.compile(r"(?<=\S)(?=\s)")
_encodings: dict[tuple[str, str], object] = {}


def encoding(rank_file: bytes, pattern: str):
    """The library's encoding for a rank file's bytes, without special tokens; kept per process."""
    key = (hashlib.sha1(rank_file).hexdigest(), pattern)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """Cut a text at safe boundaries into pieces of about ``most`` characters."""
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, enc) -> list[int]:
    """Ids of a whole text."""
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in pieces(text):
        out += enc.encode_ordinary(piece)
    return out


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row, in one pass without a shuffle.

    Null counts as empty: 0 tokens and the digests of nothing. Repeated rows each give a row;
    other columns are left aside, whatever their names; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches_of(batches, 4 << 20):
            n, ids, mine, back = [], [], [], []
            for text in batch.column(1).to_pylist():
                got = encode(text or "", enc)
                n.append(len(got))
                packed = np.asarray(got, "<u4")
                mine.append(hashlib.sha256(packed.tobytes()).hexdigest())
                back.append(hashlib.sha256(enc.decode_bytes(got)).hexdigest())
                if with_ids:
                    ids.append(packed.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(mine, pa.string()), pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {type_of(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the raw bytes of each row's ids; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            back = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {type_of(encoded, id_col)}, decoded binary")

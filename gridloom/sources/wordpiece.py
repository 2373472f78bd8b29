"""A BPE vocabulary with word ends from a local file, applied in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import normalise, pretokens

#: Words whose ids a task remembers, and items of lists (words or ids) that it takes up at once; bounds on memory only.
KEPT, ITEMS = 1 << 17, 1 << 18
_loaded: dict[int, Merges] = {}


def default_vocabulary() -> str:
    """The JSON of the public vocabulary with word ends."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def byte_of() -> dict[str, int]:
    """The byte that each character of a piece stands for: printable ones themselves, the k-th other one 256 + k."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose lists in that column hold ITEMS items together, or of one row with more."""
    ends = np.cumsum(pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + ITEMS, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def decode_words(rows: DataFrame, key: str, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, text): pieces joined, a blank after each word end, and bytes that are no UTF-8 replaced; null ids give an empty text."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {i: p for p, i in json.loads(vocabulary)["model"]["vocab"].items()}
        to_byte = byte_of()
        for batch in chain.from_iterable(parts(b, 1) for b in batches):
            out = []
            for own in batch.column(1).to_pylist():
                words = "".join(pieces.get(i, "") for i in own or []).split("</w>")
                out.append(" ".join(bytes(to_byte[c] for c in w).decode("utf-8", "replace") for w in words).strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return rows.select(key, ids).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


class Merges:
    """A vocabulary's merges applied to words: the pair of the lowest rank is joined wherever it stands, until none is left.

    A word's ids depend on the word alone and are remembered, up to KEPT words.
    """

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.letters = {b: c for c, b in byte_of().items()}
        self.known: dict[str, list[int]] = {}

    def lists(self, words: pa.Array) -> pa.Array:
        """The ids of each list of words (null: none): each different word is looked up once, the rest are takes by position."""
        coded = words.flatten().dictionary_encode()
        found = [self.of(w) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        codes = coded.indices.to_numpy()
        # Ends of the words among the ids to come; a word's ids stand together in ``ids``.
        ends = np.concatenate(([0], np.cumsum(sizes[codes])))
        places = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], sizes[codes])
        rows = np.concatenate(([0], np.cumsum(pc.list_value_length(words).fill_null(0).to_numpy(), dtype=np.int64)))
        return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(ids[places], pa.int32()))

    def of(self, word: str) -> list[int]:
        """Ids of a word that is not empty; symbols without an id are left out."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = self.known[word] = [self.ids[s] for s in self.merged(word) if s in self.ids]
        return found

    def merged(self, word: str) -> list[str]:
        """The word's symbols once no pair is left to join; pairs of one rank are one pair, of those that overlap the first is joined."""
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        none = len(self.ranks)
        while len(symbols) > 1:
            ranks = [self.ranks.get(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            out, i = [], 0
            while i < len(symbols):
                joined = i < len(ranks) and ranks[i] == best
                out.append(symbols[i] + symbols[i + 1] if joined else symbols[i])
                i += 2 if joined else 1
            symbols = out
        return symbols


def encode_words(rows: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>) of texts: normalised and cut in pre-tokens by expressions, words merged in Arrow batches without a shuffle.

    The vocabulary's JSON travels in the closure; null and blank texts give no ids. A task takes up ITEMS words at once, or one text.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = hash(vocabulary)
        if at not in _loaded:
            _loaded[at] = Merges(vocabulary)
        merges = _loaded[at]
        for batch in chain.from_iterable(parts(b, 1) for b in batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), merges.lists(batch.column(1))], names=[key, "ids"])

    words = rows.select(key, pretokens(normalise(F.col(text))).alias("_words"))
    return words.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")

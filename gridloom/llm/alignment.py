"""Alignment of two tokenizers over the same texts, with corpus-wide counts of the linked id pairs.

A text is cut into units before each space that follows a character that is no white space. Both tokenizers end a
token there (checked when they are loaded; else a text is one unit), so a unit's tokens depend on the unit alone, and each
distinct unit of a task is encoded and aligned once. Inside the units the byte ranges of B's tokens are a static
interval index: sorted starts and ends. Every A token stabs it by two bisections, which bound the
B tokens it overlaps; a gap between tokens that no token of either side spans is a group's end.

Corpus counts go by blocks of texts. A block sends one row for each distinct id pair it holds, with the number of its
documents that hold it, and gets one row back, so a frequent pair has one row a block and not one a document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, stored, type_of

#: Bytes of text in a block, and characters of units that a task remembers; bounds on memory only.
BLOCK, KEPT = 8 << 20, 4 << 20
#: Where both tokenizers end a token: before a space that follows something else than white space.
CUT = re.compile(r"(?<=\S)(?= )")
#: Other white space before a space; without it and without two spaces in a row, every space is such a place.
ODD = re.compile(r"[^\S ] ")
#: Fixed value: how byte-level pre-tokenizers split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the mark that stands for a space in pieces.
MARK = "▁"
_made: dict[tuple[str, str], Tokenizers] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Two tokenizers from their files' bytes: ids of units, and the bytes and the printed form of each id."""

    def __init__(self, json_file: bytes, piece_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(json_file)
        self.a = Tokenizer.from_str(json_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letter = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a: list[bytes] = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.width_a, self.width_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        # Each id inside a group, and as the last of its side.
        self.printed = [b"%d%c" % (k, end) for n, last in ((self.n_a, b"|"), (self.n_b, b";")) for k in range(n) for end in b"," + last]
        self.printed_width = np.fromiter(map(len, self.printed), np.int64, len(self.printed))
        pre = spec.get("pre_tokenizer") or {}
        splits = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        self.core = self._merging(spec, vocabulary) if splits else None
        self.may_cut = bool(splits) and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.blank = self.b.piece_to_id(MARK)

    def _merging(self, spec: dict, vocabulary: dict[str, int]):
        """A's merges in the tiktoken library, which applies the same ones faster; None unless they stand in the order of their ids."""
        import tiktoken

        added = {t["content"] for t in spec.get("added_tokens") or []}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"].get("merges", [])]
        own = [vocabulary[m] for m in merges]
        if spec["model"].get("ignore_merges") or own != sorted(set(own)) or len(own) + 256 != len(vocabulary.keys() - added) or own[:1] != [256]:
            return None
        ranks = {self.bytes_a[k]: k for t, k in vocabulary.items() if t not in added}
        return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that stand after a space, which B adds by itself."""
        if self.core is None:
            a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        else:
            encode = self.core.encode_ordinary
            a = [encode(" " + t) for t in texts]
        return a, [ids if t else [self.blank] for t, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]


def tokenizers(json_file: bytes, piece_model: bytes) -> Tokenizers:
    """The pair for two files' bytes, kept per process."""
    key = (hashlib.sha1(json_file).hexdigest(), hashlib.sha1(piece_model).hexdigest())
    if key not in _made:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _made[key] = Tokenizers(json_file, piece_model)
    return _made[key]


class IntervalIndex:
    """Byte ranges that follow one another, by sorted starts and ends."""

    def __init__(self, lengths: np.ndarray):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first range that ends after each start, and the first that begins at its end or after: all between overlap."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")

    def ends_at(self, at: np.ndarray) -> np.ndarray:
        """Whether a range ends at each place, so that none spans it."""
        k = np.minimum(np.searchsorted(self.ends, at), max(0, len(self.ends) - 1))
        return self.ends[k] == at if len(self.ends) else np.zeros(len(at), bool)


class Units:
    """Aligned units of a task, each made once: sizes, links as packed id pairs, and the printed groups.

    Every unit begins with a space, which its name leaves out.
    """

    def __init__(self, both: Tokenizers):
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.printed: list[bytes] = []
        self.ok = np.zeros(0, bool)
        self.sizes = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.start = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        """Align new units."""
        if not texts:
            return
        both, n = self.both, len(texts)
        raw = [b" " + t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, n)
        ids_a, ids_b = both.encode(texts)
        ok = np.ones(n, bool)
        for ids, table, width in ((ids_a, both.bytes_a, both.width_a), (ids_b, both.bytes_b, both.width_b)):
            flat = list(chain.from_iterable(ids))
            upto = np.concatenate(([0], np.cumsum(width[np.asarray(flat, np.int64)])))[np.cumsum([0, *map(len, ids)])]
            if (np.diff(upto) != size).any() or b"".join(map(table.__getitem__, flat)) != b"".join(raw):
                ok &= np.fromiter((b"".join(map(table.__getitem__, k)) == r for k, r in zip(ids, raw, strict=True)), bool, n)
        if not ok.all():
            # Units that do not give back their bytes are left without tokens; their texts are looked at as a whole.
            ids_a, ids_b = ([k if good else [] for k, good in zip(side, ok.tolist(), strict=True)] for side in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, side), np.int64, n) for side in (ids_a, ids_b))
        a, b = (np.asarray(list(chain.from_iterable(side)), np.int64) for side in (ids_a, ids_b))
        left, right = IntervalIndex(both.width_a[a]), IntervalIndex(both.width_b[b])
        first, stop = right.stab(left.starts, left.ends)
        many = stop - first
        pairs = np.repeat(a, many) * both.n_b + b[ranges(first, many)]
        last_a, last_b = right.ends_at(left.ends), left.ends_at(right.ends)
        unit_a = np.repeat(np.arange(n), n_a)
        groups = np.bincount(unit_a[last_a], minlength=n)
        n_links = np.bincount(unit_a, many, n).astype(np.int64)
        # A group prints its A ids and then its B ids: each token's place is its own and that of the other side's groups before.
        ahead = lambda last: np.concatenate(([0], np.flatnonzero(last) + 1))
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + ahead(last_b)[group_a]] = 2 * a + last_a
        words[np.arange(len(b)) + ahead(last_a)[group_b + 1]] = 2 * (b + both.n_a) + last_b
        printed = b"".join(map(both.printed.__getitem__, words.tolist()))
        upto = np.concatenate(([0], np.cumsum(both.printed_width[words])))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        self.printed += [printed[i:j] for i, j in zip(upto, upto[1:], strict=False)]
        self.start = np.concatenate((self.start, len(self.links) + np.cumsum(n_links) - n_links))
        self.links = np.concatenate((self.links, pairs))
        self.sizes = np.concatenate((self.sizes, np.stack((n_a, n_b, groups, n_links), 1)))
        self.ok = np.concatenate((self.ok, ok))
        self.at.update(zip(texts, range(len(self.at), len(self.at) + n), strict=True))
        self.chars += sum(map(len, texts))

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts in order, by number, and how many each has: none if a text is empty or does not give back its bytes."""
        parts = [parted(t, self.both.may_cut) for t in texts]
        self.add(list(set(chain.from_iterable(parts)).difference(self.at)))
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        own = np.asarray(list(map(self.at.__getitem__, chain.from_iterable(parts))), np.int64)
        if self.ok[own].all():
            return own, many
        broken = np.unique(np.repeat(np.arange(len(texts)), many)[~self.ok[own]]).tolist()
        self.add(list({texts[i] for i in broken}.difference(self.at)))
        split = np.split(own, np.cumsum(many)[:-1])
        for i in broken:
            whole = self.at[texts[i]]
            split[i] = np.asarray([whole] if self.ok[whole] else [], np.int64)
        return np.concatenate(split), np.fromiter(map(len, split), np.int64, len(split))


def parted(text: str | None, cut: bool) -> list[str]:
    """The units of a text that stands after a space, each without the space it begins with."""
    if not text:
        return []
    if not cut:
        return [text]
    if text[0] != " " and "  " not in text and not ODD.search(text):
        return text.split(" ")
    return [u[1:] for u in CUT.split(" " + text)]


def ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, as many of each."""
    return np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each comes."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _aligned(docs: DataFrame, json_file: bytes, piece_model: bytes, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds by block: a text's figures with its pairs by their places in the block's list, and that list."""
    kind = type_of(docs, id_col)
    fields = f"block bigint, id {kind}, sizes array<bigint>, printed string, steps array<int>, times array<int>, pairs array<bigint>, held array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(tokenizers(json_file, piece_model))
        every = units.both.n_a * units.both.n_b
        block, size, held = TaskContext.get().partitionId() << 33, 0, []
        key_type = pa.null()

        def flush() -> Iterator[pa.RecordBatch]:
            """The block's texts, then its list of pairs."""
            nonlocal block, size, held
            if not held:
                return
            known, place = np.unique(np.concatenate([p for *_, p, _ in held]), return_inverse=True)
            seen = np.bincount(place, minlength=len(known))
            lists = lambda arrays, t: pa.array(arrays, pa.list_(t))
            names = ["block", "id", "sizes", "printed", "steps", "times", "pairs", "held"]
            at = 0
            for i in range(0, len(held), 1000):
                some = held[i : i + 1000]
                steps = []
                for *_, pairs, _ in some:
                    steps.append(np.diff(place[at : at + len(pairs)], prepend=0).astype(np.int32))
                    at += len(pairs)
                none = [None] * len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(some), pa.int64()), pa.array([x[0] for x in some], key_type), lists([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.string()), lists(steps, pa.int32()), lists([x[4] for x in some], pa.int32()), lists(none, pa.int64()), lists(none, pa.int32())],
                    names=names,
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([None], key_type), lists([None], pa.int64()), pa.array([None], pa.string()), lists([None], pa.int32()), lists([None], pa.int32()), lists([known], pa.int64()), lists([seen.astype(np.int32)], pa.int32())],
                names=names,
            )
            block, size, held = block + 1, 0, []

        for batch in batches_of(batches, 2 << 20):
            key_type = batch.schema.field(0).type
            if units.chars > KEPT:
                units.clear()
            own, many = units.of(batch.column(1).to_pylist())
            upto = np.concatenate(([0], np.cumsum(many)))
            sizes = np.diff(np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(units.sizes[own], axis=0)))[upto], axis=0)
            # All links of the batch, by text: sorted with the text's number in front, each distinct pair with its times.
            links = units.links[ranges(units.start[own], units.sizes[own, 3])] + np.repeat(np.arange(len(many)), sizes[:, 3]) * every
            pairs, times = _runs(np.sort(links))
            bounds = np.searchsorted(pairs, np.arange(len(many) + 1) * every).tolist()
            words, upto = list(map(units.printed.__getitem__, own.tolist())), upto.tolist()
            for k, key in enumerate(batch.column(0).to_pylist()):
                printed = b"".join(words[upto[k] : upto[k + 1]])[:-1]
                i, j = bounds[k], bounds[k + 1]
                held.append((key, sizes[k], hashlib.sha256(printed).hexdigest() if printed else "", pairs[i:j] - k * every, times[i:j].astype(np.int32)))
            size += batch.column(1).nbytes
            if size > BLOCK:
                yield from flush()
        yield from flush()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, fields)


def align_tokens(docs: DataFrame, json_file: bytes, piece_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A is a byte-level JSON tokenizer and B a piece model; both see the text after one space. A pair's count is the number
    of rows that hold it linked; ``n_best`` counts a row's links whose pair has the highest count of its A id, ties included.
    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens and zeros.
    Repeated rows and ids each give a row and count each; other columns are left aside; no rows give no rows.
    A very long text is aligned whole: memory is bounded by BLOCK and KEPT, or one text.
    """
    texts = stored(_aligned(docs, json_file, piece_model, id_col, text_col))
    sent = texts.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("i", "p")).select("block", "i", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = sent.groupBy("pair").agg(F.sum("held").alias("n"))
    width = tokenizers(json_file, piece_model).n_b
    known = counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(F.floor(F.col("pair") / width))))
    # Under a name of its own, as both sides come from one table.
    answers = sent.join(known, "pair").select(F.col("block").alias("answered"), "i", "n", "best")
    kind = type_of(docs, id_col)

    def finish(rows: pa.Table, answer: pa.Table) -> pa.Table:
        order = np.argsort(answer["i"].to_numpy())
        n, best = answer["n"].to_numpy()[order], answer["best"].to_numpy(zero_copy_only=False)[order]
        n_best, total = [], []
        for steps, times in zip(rows["steps"], rows["times"], strict=True):
            at, t = np.cumsum(steps.values.to_numpy()), times.values.to_numpy().astype(np.int64)
            n_best.append(int(t[best[at]].sum()) if len(at) else 0)
            total.append(int((t * n[at]).sum()) if len(at) else 0)
        sizes = rows["sizes"].combine_chunks().flatten().to_numpy().reshape(-1, 4)
        return pa.table({id_col: rows["id"], "n_a": sizes[:, 0], "n_b": sizes[:, 1], "n_groups": sizes[:, 2], "n_links": sizes[:, 3], "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": rows["printed"]})

    rows = texts.where("pairs is null").select("block", "id", "sizes", "printed", "steps", "times")
    out = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return rows.groupBy("block").cogroup(answers.groupBy("answered")).applyInArrow(finish, out)


def groups_of(text: str, json_file: bytes, piece_model: bytes) -> list[tuple[list[int], list[int]]]:
    """The aligned groups of one text as A and B ids, for inspection."""
    units = Units(tokenizers(json_file, piece_model))
    own, _ = units.of([text])
    printed = b"".join(units.printed[k] for k in own.tolist())[:-1].decode()
    return [tuple([int(k) for k in side.split(",")] for side in g.split("|")) for g in printed.split(";")] if printed else []

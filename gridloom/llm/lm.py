"""LM scoring by deleted interpolation of n-gram estimates.

P(w | v) = a(b) * c(v w) / c(v) + u(b) * c(w) / N + z(b) / (V + 1), where b is the bucket of log2 of the
context's count c(v). The weights a, u, z of each bucket come from expectation-maximisation over
bigrams held out of the counts. Their estimates are exact functions of three counts (bigram, context, word), so the
held-out tokens are added up by these counts into a table, and each round is one aggregate over it that
sends one row a bucket to the driver. Shares are added as integers, so reruns agree to the last bit. The
probabilities over the V known words and one unknown sum to 1.

Counts travel packed. Documents are dealt to blocks of bounded bytes by a hash of id and text; rows equal in both
are one row with a number of copies from there on, so neither a hot id nor a hot row fills a block. A block sends its sorted
distinct word and bigram hashes with their counts, cut into hash ranges, and answers come back in the order of
each question, so they carry no keys. A frequent word is one entry a block, so no range is hot. Hashes
have 64 bits (see hashing).

The exchange has two levels, as B blocks that wrote to B ranges each would make B * B messages: about sqrt(B)
blocks are a group and sqrt(B) ranges a coarse range. Blocks send to coarse ranges, where each group's questions
are merged; merged ones go on to the ranges, which add up all groups; answers return the same way. That makes about
4 * B ** 1.5 messages, each of a group's or a block's keys of one range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checkpoint, release, repeated, stored, temporary_tables, type_of
from gridloom.llm.hashing import combine, word_hashes

_U = np.uint64
#: Fixed hashes of the start and the end of a text.
START, END = _U(0x2545F4914F6CDD1D), _U(0x9E6C63D0876A9A47)
#: Text bytes of a block; rounds of EM at most; it ends once no weight moves by more than TOLERANCE.
BLOCK_BYTES, ROUNDS, TOLERANCE = 16 << 20, 60, 1e-3
#: One training document in so many is held out for the weights.
HELD_OUT = 16


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers by byte plane, deflated: small numbers cost about a byte and less."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    top = next((k for k in range(8, 0, -1) if planes[k - 1].any()), 0)
    return bytes([top]) + zlib.compress(planes[:top].tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    """What ``pack`` was given."""
    top, raw = data[0], np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    if not top:
        return np.zeros(0, np.uint64)
    planes = raw.reshape(top, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :top] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences in byte planes; random low bytes stay as they are."""
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    """What ``pack_sorted`` was given."""
    return np.cumsum(unpack(data), dtype=np.uint64)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a row: each token's hash (an end after each text's words), its context's hash, tokens a text."""
    words, contexts, counts = [], [], []
    at = 0
    while at < len(texts):
        # Small groups keep the arrays in the cache.
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < 1 << 18):
            size += len(texts[stop])
            stop += 1
        h, n = word_hashes(texts[at:stop])
        ends = np.cumsum(n)
        w = np.insert(h, ends, END)
        c = np.empty_like(w)
        c[1:] = w[:-1]
        first = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
        c[first] = START
        words.append(w)
        contexts.append(c)
        counts.append(n + 1)
        at = stop
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(contexts), np.concatenate(counts)


def _block_arrays(texts: list[bytes]):
    """A block's starts of texts (a mask) and tokens a text; its sorted distinct words and bigrams, and each token's place among them."""
    w, c, n = tokens(texts)
    # With an inverse, unique sorts; without, it builds a slower hash table.
    bi, pairs = np.unique(combine([c, w]) if len(w) else w, return_inverse=True)
    first = c == START
    del c
    uni, places = np.unique(np.concatenate((w, [START, END])), return_inverse=True)
    return first, n, uni, places[:-2], bi, pairs


def _cut(keys: np.ndarray, ranges: int, together: int = 1) -> list[tuple[int, int, int]]:
    """(number, start, end) of the equal hash ranges, or runs of ``together`` of them, that have some of the sorted keys."""
    number = (((keys >> _U(32)) * _U(ranges)) >> _U(32)) // _U(together)
    starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(keys) else []
    ends = [*starts[1:], len(keys)]
    return [(int(number[i]), int(i), int(j)) for i, j in zip(starts, ends, strict=False)]


def _counts(values: np.ndarray) -> bytes:
    return pack(values.astype(np.uint64) + _U(1))


def _uncounted(data: bytes) -> np.ndarray:
    return (unpack(data) - _U(1)).astype(np.int64)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    types = {"level": pa.int32(), "coarse": pa.int32(), "fine": pa.int32(), "kind": pa.string(), "block": pa.int64(), "family": pa.int64(), "sums": pa.list_(pa.int64())}
    return pa.table([pa.array([r[i] for r in rows], types.get(n, pa.binary())) for i, n in enumerate(names)], names=names)


def _ask(table: pa.Table, ranges: int, together: int) -> pa.Table:
    """A block's keys and counts, a row for each level and coarse range."""
    block, family, kind = (table[c][0].as_py() for c in ("block", "family", "kind"))
    texts = [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
    _, n, uni, places, bi, pairs = _block_arrays(texts)
    copies = np.repeat(table["copies"].to_numpy(), n)
    rows: list[tuple] = []
    for level, keys, seen in ((1, uni, places), (2, bi, pairs)):
        # Sums of whole numbers, exact in doubles up to 2 ** 53.
        counts = np.bincount(seen, copies, len(keys)).astype(np.int64) if kind != "score" else np.zeros(len(keys), np.int64)
        rows += [(level, r, family, block, kind, pack_sorted(keys[i:j]), _counts(counts[i:j])) for r, i, j in _cut(keys, ranges, together)]
    return _table(rows, ["level", "coarse", "family", "block", "kind", "keys", "counts"])


def _questions(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted distinct keys of all rows, and each row's places among them."""
    keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def _merge(table: pa.Table, ranges: int, together: int) -> pa.Table:
    """The questions of one group of blocks for one level and coarse range as one, a row for each range."""
    every, where = _questions(table)
    known = np.zeros(len(every), np.int64)
    for own, counts in zip(where, table["counts"].to_pylist(), strict=True):
        known[own] += _uncounted(counts)
    level, coarse, family, kind = (table[c][0].as_py() for c in ("level", "coarse", "family", "kind"))
    rows = [(level, coarse, r % together, family, kind, pack_sorted(every[i:j]), _counts(known[i:j])) for r, i, j in _cut(every, ranges)]
    return _table(rows, ["level", "coarse", "fine", "family", "kind", "keys", "counts"])


def _answer(table: pa.Table) -> pa.Table:
    """All groups' questions for one level and range: sums of counts, back in the order of each question.

    ``known`` are counts over all training texts, ``early`` those without the held-out ones, which only groups of
    held-out blocks need. The row of family -1 has the range's number of known words and its tokens.
    """
    every, where = _questions(table)
    kinds = table["kind"].to_pylist()
    known, held = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    for own, counts, kind in zip(where, table["counts"].to_pylist(), kinds, strict=True):
        if kind != "score":
            known[own] += _uncounted(counts)
        if kind == "held":
            held[own] += _uncounted(counts)
    early = known - held
    level, coarse, fine = (table[c][0].as_py() for c in ("level", "coarse", "fine"))
    rows = [(level, coarse, fine, f, _counts(known[own]), _counts(early[own]) if kind == "held" else None, None) for f, own, kind in zip(table["family"].to_pylist(), where, kinds, strict=True)]
    rows.append((level, coarse, fine, -1, None, None, [int((known > 0).sum()), int(known.sum()), int((early > 0).sum()), int(early.sum())]))
    return _table(rows, ["level", "coarse", "fine", "family", "known", "early", "sums"])


def _hand_back(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """The ranges' answers to a group's question, handed to its blocks in the order of each one's own; sums go through."""
    names = ["level", "coarse", "block", "known", "early", "sums"]
    answers = answers.sort_by("fine")
    if not asked.num_rows:
        return _table([(*r, -1, None, None, sums) for *r, sums in zip(*(answers[c].to_pylist() for c in ("level", "coarse", "sums")), strict=True)], names)
    every, where = _questions(asked)
    joined = {c: np.concatenate([_uncounted(x) for x in answers[c].to_pylist()]) if answers[c].null_count == 0 else None for c in ("known", "early")}
    if len(joined["known"]) != len(every):
        raise ValueError("a group's answers do not match its question")
    part = lambda c, own: None if joined[c] is None else _counts(joined[c][own])
    return _table([(level, coarse, block, part("known", own), part("early", own), None) for level, coarse, block, own in zip(*(asked[c].to_pylist() for c in ("level", "coarse", "block")), where, strict=True)], names)


def _told(answers: pa.Table, column: str, uni: np.ndarray, bi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's counts by word and by bigram, from the answers of all ranges."""
    rows = sorted(zip(answers["level"].to_pylist(), answers["coarse"].to_pylist(), answers[column].to_pylist(), strict=True), key=lambda r: r[:2])
    parts = {level: [unpack(r[2]) - _U(1) for r in rows if r[0] == level] for level in (1, 2)}
    out = []
    for level, keys in ((1, uni), (2, bi)):
        counts = np.concatenate(parts[level]).astype(np.int64) if parts[level] else np.zeros(0, np.int64)
        if len(counts) != len(keys):
            raise ValueError("a block's answers do not match its words")
        out.append(counts)
    return out[0], out[1]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: 0 for none, else 1 + floor(log2)."""
    return np.frexp(context.astype(np.float64))[1]


def _figures(docs: pa.Table, answers: pa.Table, column: str):
    """Per token of a block: count of its word, of its bigram and of its context; and tokens a text."""
    texts = [t or b"" for t in docs["text"].cast(pa.binary()).to_pylist()]
    first, n, uni, places, bi, pairs = _block_arrays(texts)
    del texts
    by_word, by_bigram = _told(answers, column, uni, bi)
    word, pair = by_word[places], by_bigram[pairs]
    # A context occurs as often as its word, a start as often as an end.
    ends = by_word[np.searchsorted(uni, END)]
    context = np.where(first, ends, np.roll(word, 1))
    return word, pair, context, n


HELD = "bucket int, pair bigint, context bigint, word bigint, n bigint"


def _held_counts(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Held-out tokens of a block by their counts without the held-out texts: of the bigram, its context and its word."""
    names = [c.split()[0] for c in HELD.split(", ")]
    types = [pa.int32()] + [pa.int64()] * 4
    if not docs.num_rows or not answers.num_rows:
        return pa.table([pa.array([], t) for t in types], names=names)
    word, pair, context, n = _figures(docs, answers, "early")
    order = np.lexsort((word, context, pair))
    keys = np.stack([pair, context, word])[:, order]
    starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
    many = np.add.reduceat(np.repeat(docs["copies"].to_numpy(), n)[order], starts)
    pair, context, word = keys[:, starts]
    return pa.table([pa.array(x, t) for x, t in zip((bucket_of(context), pair, context, word, many), types, strict=True)], names=names)


def learn_weights(held: DataFrame, total: int, distinct: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict[int, tuple[float, float, float]]:
    """EM for the weights (bigram, word, uniform) of each bucket from rows (bucket, pair, context, word, n).

    One pseudo-token for each part keeps every weight above 0. ``total`` and ``distinct`` are the tokens and
    words behind the counts. A round is one job; no held-out rows give no weights. The rows are read once a round, so
    they should be stored.
    """
    seen = {r["bucket"]: r["n"] for r in held.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    # Shares as integers: the finest steps whose sum over all tokens still fits a long.
    steps = float(1 << max(0, min(40, 61 - sum(seen.values()).bit_length())))
    uniform = 1.0 / (distinct + 1)
    weights, moving = {b: np.full(3, 1 / 3) for b in seen}, sorted(seen)
    for _ in range(rounds):
        if not moving:
            break
        of = lambda part: F.get(F.array(*[F.lit(float(weights[b][part]) if b in weights else 0.0) for b in range(max(seen) + 1)]), F.col("bucket"))
        parts = [of(0) * F.col("pair") / F.greatest("context", F.lit(1)), of(1) * F.col("word") / F.lit(float(max(total, 1))), of(2) * F.lit(uniform)]
        share = lambda part: F.rint(part / (parts[0] + parts[1] + parts[2]) * F.col("n") * steps).cast("bigint")
        sums = held.where(F.col("bucket").isin(moving)).groupBy("bucket").agg(F.sum(share(parts[0])).alias("pair"), F.sum(share(parts[1])).alias("word"))
        still = []
        for b, *given in sums.collect():
            pair, word = (x / steps for x in given)
            new = np.asarray([pair, word, max(seen[b] - pair - word, 0.0)]) + 1.0
            new /= new.sum()
            if np.abs(new - weights[b]).max() > tolerance:
                still.append(b)
            weights[b] = new
        moving = sorted(still)
    if 0 in weights:
        a, u, z = weights[0]
        weights[0] = np.asarray([0.0, u + a / 2, z + a / 2])
    return {b: tuple(float(x) for x in w) for b, w in sorted(weights.items())}


def weight_table(weights: dict[int, tuple[float, float, float]], buckets: int = 66) -> np.ndarray:
    """Weights of all buckets; one without held-out tokens takes those of the nearest below, else above."""
    known = sorted(weights)
    rows = []
    for b in range(buckets):
        if not known:
            rows.append((0.0, 0.9, 0.1) if b == 0 else (0.3, 0.6, 0.1))
            continue
        near = max((k for k in known if k <= b), default=known[0])
        x = weights[near]
        rows.append((0.0, x[1] + x[0] / 2, x[2] + x[0] / 2) if b == 0 else x)
    return np.asarray(rows)


def _scores(docs: pa.Table, answers: pa.Table, total: int, distinct: int, weights: np.ndarray, schema: pa.Schema) -> pa.Table:
    """Each text's figures and scores."""
    if not docs.num_rows:
        return schema.empty_table()
    word, pair, context, n = _figures(docs, answers, "known")
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    base = np.log10((word + 0.5) / (total + 0.5 * (distinct + 1)))
    a = weights[bucket_of(context)]
    p = a[:, 0] * pair / np.maximum(context, 1) + a[:, 1] * word / max(total, 1) + a[:, 2] / (distinct + 1)
    sums = lambda x: np.add.reduceat(x, starts)
    many = docs.num_rows
    columns = [
        docs["id"].combine_chunks(), pa.array([docs["kind"][0].as_py() == "score"] * many, pa.bool_()),
        pa.array(n, pa.int64()), pa.array(sums((word > 0).astype(np.int64)), pa.int64()), pa.array(np.full(many, total), pa.int64()),
        pa.array(sums(base), pa.float64()), pa.array(sums(np.log10(p)), pa.float64()), docs["copies"].combine_chunks(),
    ]
    return pa.table(columns, schema=schema)


def training_by_crc(id_col: Column) -> Column:
    """True unless crc32 of the id as text leaves 1 when divided by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Callable[[Column], Column] = training_by_crc, block_bytes: int = BLOCK_BYTES, weights: np.ndarray | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from rows for which ``training`` of the id holds. A null or empty text has one token, its end.
    Repeated rows count and are scored each; other columns are left aside; no rows give no rows. Without
    training rows the one unknown word has probability 1, so every score is 0. ``weights`` gives a table as that of
    weight_table instead of learning it. Building the result runs jobs.
    """
    key = F.col(id_col).cast("string")
    held = F.pmod(F.xxhash64(F.lit("held-out"), F.coalesce(key, F.lit(""))), F.lit(HELD_OUT)) == 0
    kind = F.when(~training(F.col(id_col)), "score").when(held, "held").otherwise("train")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), kind.alias("kind"))
    sizes = rows.groupBy("kind").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).collect()
    blocks = {r["kind"]: max(1, -(-r["n"] // block_bytes)) for r in sizes}
    number = {k: i for i, k in enumerate(("train", "held", "score"))}
    total_blocks = max(1, sum(blocks.values()))
    # Ranges of a coarse range, and blocks of a family (a group of blocks of one kind).
    together = math.isqrt(total_blocks - 1) + 1
    ranges = -(-total_blocks // together) * together
    place = family = F.lit(0)
    for k, n in blocks.items():
        of_kind = F.pmod(F.xxhash64("id", "text"), F.lit(n))
        place = F.when(F.col("kind") == k, of_kind * 3 + number[k]).otherwise(place)
        family = F.when(F.col("kind") == k, F.floor(of_kind / together) * 3 + number[k]).otherwise(family)
    # A task is about one block: hashing to a fixed number of partitions would make tasks grow with the corpus.
    dealt = lambda df: df.repartition(total_blocks, "block")
    rows = dealt(rows.withColumns({"block": place.cast("bigint"), "family": family.cast("bigint")}))
    rows = rows.groupBy("block", "family", "kind", "id", "text").agg(F.count("*").alias("copies"))
    asked = rows.groupBy("block").applyInArrow(lambda t: _ask(t, ranges, together), "level int, coarse int, family bigint, block bigint, kind string, keys binary, counts binary")
    questions = ["level", "coarse", "family"]
    merged = asked.groupBy(*questions).applyInArrow(lambda t: _merge(t, ranges, together), "level int, coarse int, fine int, family bigint, kind string, keys binary, counts binary")
    answered = merged.groupBy("level", "coarse", "fine").applyInArrow(lambda t: _answer(t), "level int, coarse int, fine int, family bigint, known binary, early binary, sums array<bigint>")
    both = asked.groupBy(*questions).cogroup(answered.groupBy(*questions))
    # Not named before, as a name would hold on to its shuffles.
    answered = checkpoint(both.applyInArrow(_hand_back, "level int, coarse int, block bigint, known binary, early binary, sums array<bigint>"))
    release(docs.sparkSession)
    sums = [F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)) for i in range(4)]
    distinct, total, early_distinct, early_total = answered.where("block = -1 and level = 1").agg(*sums).first()
    answers = answered.where("block >= 0").drop("sums")
    is_held = F.pmod("block", F.lit(3)) == number["held"]
    held_rows, held_answers = rows.where(F.col("kind") == "held"), dealt(answers.where(is_held).drop("known"))
    if weights is None:
        counted = held_rows.groupBy("block").cogroup(held_answers.groupBy("block")).applyInArrow(_held_counts, HELD)
        with temporary_tables(docs.sparkSession):
            held_out = stored(counted.groupBy("bucket", "pair", "context", "word").agg(F.sum("n").alias("n")))
            weights = weight_table(learn_weights(held_out, early_total, early_distinct))
    if not total:
        weights = np.tile([0.0, 0.0, 1.0], (len(weights), 1))
    kind_of_id = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("id", kind_of_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("copies", pa.int64())])
    scored = rows.groupBy("block").cogroup(dealt(answers.drop("early")).groupBy("block")).applyInArrow(
        lambda docs, told: _scores(docs, told, total, distinct, weights, schema),
        f"id {type_of(docs, id_col)}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, copies bigint",
    )
    return repeated(scored, "copies").drop("copies").withColumnRenamed("id", id_col)

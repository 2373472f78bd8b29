"""Token counts by a unigram model whose forward scores are shared along a trie of pre-tokens.

The distinct pre-tokens of a batch that the task has not met yet are put in a trie: sorted by code point, each word with the length
of the prefix it shares with the one before is the trie in depth-first order, so a stack of
scores by depth holds exactly the current path. Every trie node gets its forward
score once, from the pieces that end there; each word's count is kept at its terminal node, and
terminal counts stay over all batches of a task (up to KEPT words, then they start anew).

Pieces come from a local model file. A unigram file brings its scores; a BPE file orders
its pieces by rank only, so their log probabilities follow Zipf's law, -ln(rank + 2.7) (a fixed
rule; nothing is trained).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import batches_of, type_of

#: Fixed value: the mark of a word's start in such vocabularies.
START = "▁"
#: Words whose counts a task keeps; a bound on memory only, as a word's count depends on the word alone.
KEPT = 1_000_000


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log scores by rank, Mandelbrot's form."""
    return {p: -math.log(rank + 2.7) for rank, p in enumerate(pieces)}


def load_pieces(model: bytes) -> dict[str, float]:
    """Piece to log score of a sentencepiece model: normal pieces, and byte pieces as <0xNN>."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    ids = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    by_rank = all(sp.get_score(i) == int(sp.get_score(i)) for i in ids)
    if not by_rank:
        return {sp.id_to_piece(i): sp.get_score(i) for i in ids}
    bytes_, normal = [i for i in ids if sp.is_byte(i)], [i for i in ids if not sp.is_byte(i)]
    normal.sort(key=lambda i: -sp.get_score(i))
    scores = zipf_scores([sp.id_to_piece(i) for i in normal])
    rare = -math.log(len(normal) + 2.7)
    return scores | {sp.id_to_piece(i): rare for i in bytes_}


class Trie:
    """Forward scores over a trie of words in depth-first order."""

    def __init__(self, scores: dict[str, float]):
        self.scores = {p: s for p, s in scores.items() if not (len(p) == 6 and p.startswith("<0x"))}
        self.longest = max(map(len, self.scores), default=1)
        self.byte = min(scores.values(), default=-10.0)

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of the best segmentation of each distinct word; ties go to fewer tokens."""
        out: dict[str, int] = {}
        best, tokens = [0.0], [0]
        before, get, longest, byte = "", self.scores.get, self.longest, self.byte
        for word in sorted(words):
            marked = START + word
            most = min(len(before), len(marked))
            shared = 0
            while shared < most and before[shared] == marked[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                # Where no piece covers a character, its UTF-8 bytes stand for it.
                last = marked[end - 1]
                width = len(last.encode("utf-8", "surrogatepass"))
                top, count = best[end - 1] + byte * width, tokens[end - 1] + width
                for begin in range(max(0, end - longest), end):
                    score = get(marked[begin:end])
                    if score is not None:
                        now, also = best[begin] + score, tokens[begin] + 1
                        if now > top or (now == top and also < count):
                            top, count = now, also
                best.append(top)
                tokens.append(count)
            out[word] = tokens[-1]
            before = marked
        return out


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of every row, in one pass without a shuffle.

    Null and blank texts have 0 of both; repeated rows each give a row; other columns are left aside.
    A word's count depends on the word alone, so batches may fall anywhere. Memory is bounded by KEPT and
    a batch's distinct words, or one text's. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counts = Trie(load_pieces(model)), {}
        for batch in batches_of(batches, 24 << 20):
            texts = [split(t) for t in batch.column(1).to_pylist()]
            new = set().union(*texts).difference(counts)
            if len(counts) > KEPT:
                counts, new = {}, new.union(*texts)
            counts.update(trie.counts(list(new)))
            get = counts.__getitem__
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array((sum(map(get, t)) for t in texts), pa.int64())],
                names=[id_col, "n_words", "n_tokens"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, n_words bigint, n_tokens bigint")


_OTHER = str.maketrans("\x0b\x0c\r\n\t", "     ")


def split(text: str | None) -> list[str]:
    """Words between the six ASCII separators only (str.split() knows more of them)."""
    if not text:
        return []
    return [w for w in text.translate(_OTHER).split(" ") if w]

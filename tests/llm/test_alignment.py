"""Alignment against a plain walk over both tokenizers' whole texts; edge cases and clashing names."""

import collections
import hashlib
import random

import pytest

from gridloom.llm import alignment, queries
from tests.llm.test_llm import docs


@pytest.fixture(scope="module")
def files():
    return queries.alignment_files()


@pytest.fixture(scope="module")
def both(files):
    return alignment.tokenizers(*files)


def spans(ids, table):
    at, out = 0, []
    for k in ids:
        out.append((at, at + len(table[k]), k))
        at += len(table[k])
    return out


def plain(text, both):
    """(A ids, B ids, links, printed groups) of one text, whole, by walking along both lists."""
    if not text:
        return [], [], [], ""
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(both.bytes_a[k] for k in a) != raw or b"".join(both.bytes_b[k] for k in b) != raw:
        return [], [], [], ""
    x, y = spans(a, both.bytes_a), spans(b, both.bytes_b)
    links = [(p[2], q[2]) for p in x for q in y if p[0] < q[1] and q[0] < p[1]] if len(x) < 400 else None
    if links is None:
        links, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            links.append((x[i][2], y[j][2]))
            p, q = x[i][1], y[j][1]
            i, j = i + (p <= q), j + (q <= p)
    groups, i, j = [], 0, 0
    for end in sorted({p[1] for p in x} & {q[1] for q in y}):
        own, other = [], []
        while i < len(x) and x[i][1] <= end:
            own.append(str(x[i][2]))
            i += 1
        while j < len(y) and y[j][1] <= end:
            other.append(str(y[j][2]))
            j += 1
        groups.append(",".join(own) + "|" + ",".join(other))
    return a, b, links, ";".join(groups)


def expected(rows, both):
    made = [(k, *plain(t, both)) for k, t in rows]
    counts = collections.Counter(p for *_, links, _ in made for p in set(links))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(k, len(a), len(b), printed.count(";") + 1 if printed else 0, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(printed.encode()).hexdigest() if printed else "") for k, a, b, links, printed in made]


ODD = ["", "a", " ", "  ", " a", "a ", "a  b", "a \n b", "\n", "▁x", "a▁ b", "<0x0A> <s> </s>", "<|endoftext|> x", "don't can't 's", "x\x00y", "ü 😀 日本語。", "a\x1c b", "a\xa0 b", "1 2  33 a1 b", "　x", None]


def test_units_encode_as_whole_texts(both):
    rng = random.Random(3)
    letters = [" ", "  ", "\n", "\t", "a", "b", "'s", "1", "é", "▁", "日", "　", "\xa0", "\x85", "\x1c", "​", "᠎", ".", "<0x41>", "😀", "the", "ing"]
    texts = [t for t in ODD if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    # One text a stretch of code points: every character stands after and before a space and between letters.
    texts += [" ".join(f"a{chr(c)} {chr(c)}b {chr(c)}1" for c in range(start, start + 997, 13) if not 0xD800 <= c < 0xE000) for start in range(1, 0x30000, 997)]
    assert both.may_cut and both.core is not None
    units = alignment.Units(both)
    own, many = units.of(texts)
    at = 0
    for text, n in zip(texts, many.tolist(), strict=True):
        printed = b"".join(units.printed[k] for k in own[at : at + n].tolist())[:-1].decode()
        assert printed == plain(text, both)[3], text
        at += n


def test_interval_index():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        x, y = (np.diff(np.concatenate(([0], np.sort(rng.choice(np.arange(1, 99), int(rng.integers(0, n)), replace=False)), [99]))) for _ in "ab")
        left, right = alignment.IntervalIndex(x), alignment.IntervalIndex(y)
        first, stop = right.stab(left.starts, left.ends)
        for s, e, i, j in zip(left.starts, left.ends, first, stop, strict=True):
            assert [k for k in range(len(y)) if right.starts[k] < e and s < right.ends[k]] == list(range(i, j))
        assert right.ends_at(left.ends).tolist() == [e in set(right.ends.tolist()) for e in left.ends.tolist()]


def test_align_tokens(spark, files, both, monkeypatch):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma's", "δέλτα", "straße", "naïve", "1234", "x", "😀", "日本語"]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    rows += [(7, "alpha alpha Beta"), (7, "alpha alpha Beta"), (None, "alpha"), (None, None), (900, "alpha naïve " * 20000), (901, "日" * 30000)]
    monkeypatch.setattr(alignment, "BLOCK", 2000)
    monkeypatch.setattr(alignment, "KEPT", 300)
    frame = docs(spark, [(k, t, "s") for k, t in rows]).repartition(3)
    got = [tuple(r) for r in alignment.align_tokens(frame, *files).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows, both), key=repr)
    empty = alignment.align_tokens(docs(spark, []), *files)
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_names_and_kinds(spark, files, both):
    rows = [("p", "alpha beta", 1), (None, None, 2), ("p", "alpha", 3)]
    frame = spark.createDataFrame(rows, "`a b` string, pairs string, block int")
    got = [tuple(r) for r in alignment.align_tokens(frame, *files, id_col="a b", text_col="pairs").collect()]
    assert sorted(got, key=repr) == sorted(expected([r[:2] for r in rows], both), key=repr)
    assert alignment.groups_of("alpha", *files) == [tuple([int(k) for k in side.split(",")] for side in g.split("|")) for g in plain("alpha", both)[3].split(";")]
    assert alignment.groups_of("", *files) == []


def test_hot_texts(spark, files, both):
    rows = [(k, "the same words in three of four texts" if k % 4 else f"text {k}") for k in range(400)]
    got = [tuple(r) for r in alignment.align_tokens(docs(spark, [(k, t, "s") for k, t in rows]), *files).collect()]
    assert sorted(got) == sorted(expected(rows, both))


def test_op11_over_documents(spark, sf_dir, files, both):
    table = queries.read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = [tuple(r) for r in queries.op11_token_alignment(spark, sf_dir).collect()]
    assert sorted(got) == sorted(expected([tuple(r) for r in table], both))

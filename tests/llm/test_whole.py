"""Whole queries and the pipeline against plain Python, and the stages' edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import bpe, dedup, mixing, quality, queries, token_counts
from tests.llm import test_pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, _row string, _key string, _text string, _gone string, positions string, digest string, id string, `a.b` string, `c``d` string"


def made(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefghi") for r in rows], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def figures(t):
    """The figures of a text by plain counting."""
    t, w = t or "", words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_lines": t.count("\n") + 1, "n_upper": len(re.findall("[A-Z]", t)), "n_function": sum(x in set(quality.FUNCTION_WORDS) for x in w), "n_ends": sum(x[-1] in ".?!" for x in w),
    }


def votes(q):
    n = max(q["n_words"], 1)
    share = {k: q[k] / n for k in ("n_symbols", "n_repeat_words", "n_function", "n_ends")}
    upper, length = q["n_upper"] / max(q["word_chars"], 1), q["word_chars"] / n
    rules = [
        (share["n_symbols"] > 0.3, share["n_symbols"] < 0.05), (upper > 0.5, upper < 0.2), (share["n_repeat_words"] > 0.3, share["n_repeat_words"] < 0.15),
        (q["n_dup_lines"] * 4 > q["n_lines"], q["n_dup_lines"] == 0 and q["n_lines"] > 1), (q["n_words"] < 20, q["n_words"] >= 60), (share["n_function"] < 0.02 and q["n_words"] >= 20, share["n_function"] > 0.08),
        (share["n_ends"] > 0.4 or (q["n_ends"] == 0 and q["n_words"] >= 60), 0.02 <= share["n_ends"] <= 0.25), (length < 2.5 or length > 14, 3 <= length <= 11),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in rules]


def judged(texts):
    """(kept, quality) of each text: EM over the texts themselves, one row each."""
    all_figures = [figures(t) for t in texts]
    v = np.asarray([votes(q) for q in all_figures])
    pseudo = max(10.0, 0.05 * len(v))
    prior, good, bad = 0.8, np.full(8, 0.98), np.full(8, 0.4)

    def chance():
        odds = math.log(prior / (1 - prior)) + np.where(v > 0, np.log(good / (1 - bad)), 0).sum(axis=1) + np.where(v < 0, np.log((1 - good) / bad), 0).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    for _ in range(100):
        p = chance()[:, None]
        new = (p.sum() + 8) / (len(v) + 10)
        good_hits, good_seen = (p * (v > 0)).sum(axis=0) + 0.98 * pseudo, (p * (v != 0)).sum(axis=0) + pseudo
        bad_hits, bad_seen = ((1 - p) * (v < 0)).sum(axis=0) + 0.4 * pseudo, ((1 - p) * (v != 0)).sum(axis=0) + pseudo
        done = abs(new - prior) < 1e-9
        prior, good, bad = min(0.99, max(0.01, new)), np.minimum(0.999, good_hits / good_seen), np.minimum(0.999, bad_hits / bad_seen)
        if done:
            break
    p = chance()
    fails = [q["n_words"] < 50 or 100 * q["n_repeat_words"] > 50 * q["n_words"] for q in all_figures]
    return [(not f and x >= 0.5, x) for f, x in zip(fails, p.tolist(), strict=True)]


def test_quality_query_by_plain_em(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], judged([r["text"] for r in docs]), strict=True))
    got = {r["doc_id"]: (r["kept"], r["quality"]) for r in queries.QUERIES["op2_quality_rules"](spark, sf_dir).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)


def filled(sizes):
    """Targets by sharing what is left among the open sources until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    capped, rest = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 3 * sizes[s]
            rest -= capped[s]


def passes(rows):
    """(place in training, row number) of each pass over each row (id, text, source), by walking every source's stream."""
    sizes, sources = [len(words(t)) for _, t, _ in rows], collections.defaultdict(list)
    for k, (_, _, s) in enumerate(rows):
        sources[s].append(k)
    totals = {s: sum(sizes[k] for k in own) for s, own in sources.items()}
    targets = filled(totals)
    taken, out = collections.Counter(), []
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    for s, own in sources.items():
        knots = mixing.SCHEDULES[order.index(s) % 3]
        key = lambda k: hashlib.md5(f"0:{rows[k][0] if rows[k][0] is not None else hashlib.md5((rows[k][1] or '').encode()).hexdigest()}".encode()).hexdigest()
        at = 0
        for _ in range(3):
            for k in sorted(own, key=key):
                left = math.floor(targets[s]) - at
                if sizes[k] and left > 0:
                    taken[k] += min(sizes[k], left)
                    grid = np.linspace(0, 1, 200_001)
                    rate = np.interp(grid, [x for x, _ in knots], [y for _, y in knots])
                    used = np.concatenate(([0], np.cumsum((rate[1:] + rate[:-1]) / 2 / 200_000)))
                    out.append((float(np.interp(at / targets[s] * used[-1], used, grid)), k))
                at += sizes[k]
    return targets, taken, sorted(out)


def test_mixing_query_by_iteration(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    targets, taken, stream = passes(rows)
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_curriculum_mix"](spark, sf_dir).collect()}
    first = {}
    for at, k in stream:
        first.setdefault(k, at)
    for k, (i, _, s) in enumerate(rows):
        assert got[i]["target"] == pytest.approx(targets[s]) and got[i]["taken"] == taken[k]
        assert (got[i]["first_position"] is None) == (k not in first) and (k not in first or got[i]["first_position"] == pytest.approx(first[k], abs=2e-5))


def test_token_count_query_by_plain_segmentation(spark, sf_dir):
    """Every word's best segmentation by a plain dynamic programme without a trie."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        scores = token_counts.load_pieces(f.read())
    pieces = {p: s for p, s in scores.items() if not re.fullmatch("<0x..>", p)}
    longest, byte = max(map(len, pieces)), min(scores.values())

    def best(w):
        w = "▁" + w
        top = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            n = len(w[end - 1].encode())
            options = [(top[end - 1][0] + byte * n, top[end - 1][1] - n)]
            options += [(top[b][0] + pieces[w[b:end]], top[b][1] - 1) for b in range(max(0, end - longest), end) if w[b:end] in pieces]
            top.append(max(options))
        return -top[-1][1]

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = {w: best(w) for w in set(itertools.chain(*map(words, texts.values())))}
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in queries.QUERIES["op5_token_counts"](spark, sf_dir).collect()}
    assert got == {i: (len(words(t)), sum(counts[w] for w in words(t))) for i, t in texts.items()}


def test_token_counts_kept_over_batches(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    trie_words = []
    plain = token_counts.Trie.counts
    monkeypatch.setattr(token_counts.Trie, "counts", lambda self, w: trie_words.append(sorted(w)) or plain(self, w))
    monkeypatch.setattr(token_counts, "batches_of", lambda batches, most: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    monkeypatch.setattr(token_counts, "load_pieces", lambda model: token_counts.zipf_scores(["▁", "a", "b", "ab", "▁a"]))
    import pyarrow as pa

    class Rows:
        schema = {"doc_id": type("F", (), {"dataType": type("D", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            texts = ["a b", "ab b a", "a bb aab", "b"]
            return list(run([pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["doc_id", "text"])]))

    out = token_counts.count_tokens(Rows(), b"")
    assert [b.column(1).to_pylist() for b in out] == [[2], [3], [3], [1]] and trie_words == [["a", "b"], ["ab"], ["aab", "bb"], ["b"]]


def components(rows, percent):
    sets = []
    for _, t, _ in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    return label


def prose(rng, n):
    plain = [f"{a}{b}" for a in ("ta", "mi", "ro", "len", "sa") for b in ("den", "gor", "lit", "pas", "vu")]
    out = []
    for k in range(n):
        w = rng.choice(["the", "of", "and", "to"]) if k % 4 == 0 else rng.choice(plain) + rng.choice("aeiou")
        out.append(w + ("." if k % 12 == 11 else "") + ("\n" if k % 48 == 47 else ""))
    return " ".join(out)


def test_pipeline_by_plain_python(spark, tmp_path):
    """All five stages on a small table against plain Python: ids, order of the stream and token ids."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 120 + 10 * (i % 7)), "abc"[i % 3] if i % 5 else None) for i in range(40)]
    near = lambda t: t.replace(t.split()[60], "changed", 1)
    rows += [(50, rows[7][1], "a"), (51, near(rows[9][1]), "b"), (52, "# $ % & | " * 60, "c"), (53, "short", "a"), (54, None, "b"), (55, rows[2][1] + " write to ann.lee@x.org or 212-555-0100 now.", "c"), (56, "SHOUT " * 80, "a")]
    path = tmp_path / "sf"
    made(spark, rows).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.conf.set("gridloom.pii.key", test_pii.KEY)
    try:
        got = corpus_pipeline.run(spark, str(path)).select("doc_id", "ids").collect()
    finally:
        spark.conf.unset("gridloom.pii.key")
    kept = [r for r, (k, _) in zip(rows, judged([t for _, t, _ in rows]), strict=True) if k]
    assert {52, 53, 54, 56}.isdisjoint(r[0] for r in kept) and len(kept) >= 40
    label, first = components(kept, 80), {}
    for k, r in enumerate(kept):
        if label[k] not in first or r[0] < first[label[k]][0]:
            first[label[k]] = r
    left = sorted(first.values())
    assert {50, 51}.isdisjoint(r[0] for r in left)
    replaced = lambda t: t.replace("ann.lee@x.org", test_pii.email("ann.lee@x.org")).replace("212-555-0100", test_pii.phone("212-555-0100"))
    clean = [(i, replaced(t), s) for i, t, s in left]
    _, _, stream = passes(clean)
    enc = bpe.encoding(*queries.rank_file())
    ids = {i: enc.encode_ordinary(t) for i, t, _ in clean}
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(clean[k][0] for _, k in stream)
    assert all(list(r["ids"]) == ids[r["doc_id"]] for r in got)


EDGES = [(None, None, None), (None, "", "a"), (1, None, "a"), (1, " \n", "a"), (2, "x", None), (2, "x", None), (3, "a b c d e f g " * 40, "b"), (4, "é" * 300_000, "b"), (5, "word " * 100_000, None)]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_edge_cases(spark, name, stage):
    rng = random.Random(8)
    rows = [*EDGES, *[(10 + i, prose(rng, 100), "a") for i in range(4)], (10, prose(rng, 100), "a"), (None, prose(rng, 90), None)]
    docs = made(spark, rows)
    out = stage(spark, docs, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    got = collections.Counter(r[0] for r in out.select("doc_id").collect())
    empty = stage(spark, docs.limit(0), "")
    assert empty.columns == out.columns and empty.count() == 0
    every = collections.Counter(r[0] for r in rows)
    want = {
        "quality rules": collections.Counter({10: 2, 11: 1, 12: 1, 13: 1, None: 1}),
        "near dedup": collections.Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 1, 11: 1, 12: 1, 13: 1, None: 3}),
        "pii": every, "bpe": every,
    }
    if name == "mixing":
        assert set(got) <= {2, 3, 4, 5, 10, 11, 12, 13, None} and max(got.values()) <= 3 * max(every.values())
    else:
        assert got == want[name]


def test_one_id_with_several_texts(spark):
    """The text of the smallest digest stands for its id, whatever the order of rows; each row has the component of its id."""
    rng = random.Random(9)
    a, b, c = (prose(rng, 80) for _ in range(3))
    near = lambda t: "changed " + t
    rows = [(5, a, "x"), (5, b, "x"), (5, "", "x"), (2, near(a), "x"), (3, near(b), "x"), (7, c, "x")]
    seen = set()
    for order in (rows, rows[::-1]):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(made(spark, order)).collect())
        seen.add(tuple(got))
    assert len(seen) == 1
    by = collections.defaultdict(set)
    for i, n, comp in seen.pop():
        if n:
            by[i].add(comp)
    assert by[5] in ({2}, {3}) and by[7] == {7} and len(by[5] & (by[2] | by[3])) == 1


def test_bpe_and_scan_of_nothing(spark):
    ranks, pattern = queries.rank_file()
    none = made(spark, EDGES[:4])
    assert {r["n_tokens"] for r in bpe.encode_documents(none.where(F.coalesce(F.trim("text"), F.lit("")) == ""), ranks, pattern).collect()} == {0}
    assert bpe.encode_documents(none.limit(0), ranks, pattern).count() == 0 and quality.score_documents(none.limit(0)).count() == 0

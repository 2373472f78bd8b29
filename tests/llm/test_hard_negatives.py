"""Hard negatives against a plain search, in SQL and in Python, with ties, copies, nulls and large numbers."""

import random

import numpy as np
import pytest

from gridloom.llm import hard_negatives as H
from gridloom.llm import queries
from tests.support.compare import check


def plain(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, v); a row is another by its place in the list."""
    out = []
    good = [(i, l, v, at) for at, (i, l, v) in enumerate(rows) if l is not None and v is not None and None not in v]
    key = lambda s, i, at: (-s, i is None, i or 0, at)
    for i, l, v, at in good:
        if not anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, m, b) for j, m, w, b in good if b != at and len(w) == len(v)]
        first = sorted((key(s, j, b), s, j) for s, j, m, b in scored if m == l)[:positives]
        for _, p, j in first:
            hard = sorted((key(s, n, b), s, n) for s, n, m, b in scored if m != l and low * p <= 100 * s <= high * p)[:negatives]
            out += [(i, j, k + 1, n, p, s) for k, (_, s, n) in enumerate(hard)]
    return sorted(out, key=repr)


def made(seed, n, d, labels=3, low=-4, high=6):
    rng = random.Random(seed)
    return [(k, rng.randrange(labels), [rng.randint(low, high) for _ in range(d)]) for k in range(n)]


def run(spark, rows, condition="id % 10 = 0", **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "id bigint, label bigint, v array<bigint>, anchor string, p int").coalesce(1)
    return sorted((tuple(r) for r in H.mine(frame, condition, **options).collect()), key=repr)


@pytest.mark.parametrize("seed,d,block", [(1, 3, 50), (2, 8, 64), (3, 1, 1000), (4, 16, 37)])
def test_against_plain_search(spark, seed, d, block):
    """Few values a component, so that ties are many."""
    rows = made(seed, 300, d)
    assert run(spark, rows, leaf_rows=block) == plain(rows, lambda i: i % 10 == 0)


def test_other_limits(spark):
    rows = made(9, 150, 4)
    assert run(spark, rows, positives=2, negatives=3, low=50, high=100, leaf_rows=40) == plain(rows, lambda i: i % 10 == 0, 2, 3, 50, 100)


def test_odd_rows(spark):
    rows = [*made(5, 60, 4), (60, None, [1, 2, 3, 4]), (61, 1, None), (62, 1, [1, None, 3, 4]), (70, 1, [5, 5]), (80, 2, []), (90, 1, []), (None, 0, [6, 6, 6, 6]), (None, 1, [6, 6, 6, 6])]
    assert run(spark, rows, leaf_rows=20) == plain(rows, lambda i: i is not None and i % 10 == 0)
    assert run(spark, []) == [] and run(spark, [(1, 1, [2])]) == [] and run(spark, [(10, 1, [2])]) == []


def test_hot_rows(spark):
    """Three of four rows are one row, anchors among them, and one label holds most."""
    rows = [(10, 1, [3, 1]) if k % 4 else (k, 2, [k % 5, 1 + k % 3]) for k in range(160)]
    assert sorted(set(run(spark, rows, leaf_rows=25)), key=repr) == sorted(set(plain(rows, lambda i: i % 10 == 0)), key=repr)
    assert len(run(spark, rows, leaf_rows=25)) == len(plain(rows, lambda i: i % 10 == 0))


def test_large_numbers(spark):
    rng = random.Random(8)
    rows = [(k, k % 2, [rng.randint(-(2**30), 2**30) for _ in range(3)]) for k in range(60)]
    assert run(spark, rows, leaf_rows=30) == plain(rows, lambda i: i % 10 == 0)


def test_tree_holds_its_bounds_and_prunes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (20, 12))
    x = np.repeat(centres, 200, axis=0) + rng.integers(-5, 6, (4000, 12))
    labels = np.repeat(np.arange(20), 200)
    tree = H.BallTree(x, labels)
    for node, (b, e) in enumerate(zip(tree.begin, tree.end, strict=True)):
        rows = x[tree.order[b:e]]
        assert np.sqrt(((rows - tree.centre[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-6
    anchors = {"v": x[:50], "label": labels[:50], "at": np.arange(50)}
    none = np.zeros(4000, bool)
    *_, share = H.search(tree, x, np.arange(4000), none, np.arange(4000), labels, anchors, np.arange(50), np.full(50, H.NONE), np.full(50, H.LONG), True, 5)
    assert share < 0.1


def test_quantised(spark):
    rows = [(1, [0.5, -0.001], 3), (2, [float("nan"), 1.0], 3), (3, [float("inf"), 1.0], 3), (4, [None, 1.0], 3), (5, None, 3), (6, [1.0, 1.0], None), (7, [], 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert sorted(tuple(r) for r in H.quantised(frame).collect()) == [(1, 3, [128, -1]), (7, 2, [])]


def test_op13(spark, sf_dir):
    assert check(queries.op13_hard_negatives(spark, sf_dir), queries.ORACLES["op13_hard_negatives"], sf_dir) > 0

"""Propagation from frame to frame against a plain loop over frames."""

import math
import os
import random

import pytest

from gridloom.operators import propagation as P


def made(seed, frames, h, w, sequences=2, d=3, classes=3):
    rng = random.Random(seed)
    features, first = [], []
    for s in range(sequences):
        for t in range(frames - s):
            for r in range(h):
                for c in range(w):
                    features.append((s, t, r, c, [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(d)]))
                    if t == 0:
                        k = rng.randrange(classes)
                        first.append((s, r, c, [float(k == j) for j in range(classes)]))
    return features, first


def plain(features, first, queue, reach, topk, temperature):
    by = {}
    for s, t, r, c, v in features:
        n = math.sqrt(sum(x * x for x in v))
        by.setdefault(s, {}).setdefault(t, {})[r, c] = [x / n for x in v]
    out = {}
    for s, frames in by.items():
        soft = {0: {(r, c): x for q, r, c, x in first if q == s}}
        held = []
        for t in sorted(frames)[1:]:
            context = [0, *held]
            soft[t] = {}
            for (r, c), v in frames[t].items():
                near = [(round(sum(x * y for x, y in zip(v, w, strict=True)), 9), soft[f][p]) for f in context for p, w in frames[f].items() if abs(p[0] - r) <= reach and abs(p[1] - c) <= reach]
                least = sorted((x for x, _ in near), reverse=True)[min(topk, len(near)) - 1]
                kept = [(math.exp(x / temperature), y) for x, y in near if x >= least]
                total = sum(x for x, _ in kept)
                soft[t][r, c] = [sum(x * y[k] for x, y in kept) / total for k in range(len(kept[0][1]))]
            held = [*held, t][-queue:]
        out |= {(s, t, r, c): x for t, plane in soft.items() for (r, c), x in plane.items()}
    return out


def frames_of(spark, features, first):
    return spark.createDataFrame(features, "sequence bigint, frame bigint, r int, c int, v array<double>").repartition(3), spark.createDataFrame(first, "sequence bigint, r int, c int, soft array<double>")


@pytest.mark.parametrize("seed,frames,h,w,queue,reach,topk", [(1, 6, 4, 5, 2, 1, 3), (2, 4, 3, 3, 7, 12, 5), (3, 5, 6, 2, 1, 2, 1)])
def test_propagate(spark, seed, frames, h, w, queue, reach, topk):
    features, first = made(seed, frames, h, w)
    got = {(r["sequence"], r["frame"], r["r"], r["c"]): r["soft"] for r in P.propagate(*frames_of(spark, features, first), queue, reach, topk, 0.1).collect()}
    want = plain(features, first, queue, reach, topk, 0.1)
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_tiles_do_not_show(spark):
    features, first = made(4, 3, 9, 7, 1)
    rows = [sorted((r["frame"], r["r"], r["c"], str(r["votes"])) for r in P.context_votes(frames_of(spark, features, first)[0], 2, 2, 4, tile=tile).collect()) for tile in (1, 3, 50)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 2 * 63


def test_a_run_goes_on(spark, tmp_path):
    """What an earlier run wrote whole is kept; a frame that was not finished is made again, and those after it."""
    import shutil

    features, first = made(5, 5, 3, 3, 1)
    data, labels = frames_of(spark, features, first)
    folder = str(tmp_path / "run")
    whole = sorted(map(str, P.propagate(data, labels, 2, 1, 3, folder=folder).collect()))
    before = os.stat(f"{folder}/soft/frame=2/_SUCCESS").st_mtime_ns
    os.remove(f"{folder}/soft/frame=3/_SUCCESS")
    shutil.rmtree(f"{folder}/soft/frame=4")
    assert sorted(map(str, P.propagate(data, labels, 2, 1, 3, folder=folder).collect())) == whole
    assert before == os.stat(f"{folder}/soft/frame=2/_SUCCESS").st_mtime_ns and os.path.exists(f"{folder}/soft/frame=4/_SUCCESS")


def test_hard_labels(spark):
    soft = spark.createDataFrame([(0, 0, 0, 0, [0.9, 0.1, 0.0]), (0, 0, 0, 1, [0.6, 0.4, 0.0]), (0, 0, 0, 2, [0.7, 0.3, 0.0]), (1, 0, 0, 0, [0.5, 0.5, 0.0])], "sequence bigint, frame bigint, r int, c int, soft array<double>")
    assert {(r["sequence"], r["c"]): r["label"] for r in P.hard_labels(soft).collect()} == {(0, 0): 0, (0, 1): 1, (0, 2): 1, (1, 0): 0}


def test_queue(spark):
    frames = spark.createDataFrame([(s, t) for s in (0, 1) for t in range(6)], "sequence bigint, frame bigint")
    assert {r["frame"]: r["context"] for r in P.queue_of(frames, 3).where("sequence = 1").collect()} == {1: [0], 2: [0, 1], 3: [0, 1, 2], 4: [0, 1, 2, 3], 5: [0, 2, 3, 4]}


def test_arguments(spark):
    features, first = made(6, 2, 2, 2, 1)
    data, labels = frames_of(spark, features, first)
    for bad in ({"queue": 0}, {"reach": 0}, {"topk": 0}, {"temperature": 0.0}):
        with pytest.raises(ValueError):
            P.context_votes(data, **bad)
    assert P.propagate(data.limit(0), labels.limit(0)).count() == 0

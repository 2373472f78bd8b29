"""Neighbours around pivots against comparing all pairs, low-rank components against a full decomposition, repair of text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import repair as R
from gridloom.operators import lowrank as L
from gridloom.operators import neighbours as N


def unit(x):
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v.tolist(), k % 3) for k, v in enumerate(x)], "id bigint, v array<double>, label int")


def plain(x, y, k):
    sims = np.round(x @ y.T, 9)
    out = set()
    for i, s in enumerate(sims):
        least = np.sort(s)[::-1][min(k, len(s)) - 1]
        out |= {(i, int(j), s[j]) for j in np.flatnonzero(s >= least)}
    return out


def got(found):
    return {(r["t"], r["near"], r["sim"]) for r in found.collect()}


@pytest.mark.parametrize("seed,n,m,d,k,pivots", [(1, 40, 150, 5, 3, None), (2, 30, 200, 2, 7, 12), (3, 10, 4, 3, 9, None), (4, 20, 60, 3, 1, 60)])
def test_all_neighbours(spark, seed, n, m, d, k, pivots):
    rng = np.random.default_rng(seed)
    # Few directions, so that ties and copies are many.
    x, y = (unit(rng.integers(-2, 3, (c, d)) + 0.25) for c in (n, m))
    found, share = N.nearest(frame(spark, x), frame(spark, y), k, pivots or 8)
    assert got(found) == plain(x, y, k) and 0 < share <= 1


def test_clusters_are_pruned(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = unit(rng.standard_normal((30, 16)))
    x, y = (unit(centres[rng.integers(0, 30, c)] + 0.02 * rng.standard_normal((c, 16))) for c in (60, 900))
    monkeypatch.setattr(N, "BLOCK", 20)
    monkeypatch.setattr(N, "TARGETS", 7)
    found, share = N.nearest(frame(spark, x), frame(spark, y), 4, 40)
    assert got(found) == plain(x, y, 4) and share < 0.3


def test_hot_vector(spark, monkeypatch):
    """Three of four context rows are one vector: all of them are neighbours."""
    monkeypatch.setattr(N, "BLOCK", 16)
    y = unit(np.asarray([[1.0, 0.0] if k % 4 else [1.0, k] for k in range(200)]))
    x = unit(np.asarray([[1.0, 0.01], [0.0, 1.0]]))
    assert got(N.nearest(frame(spark, x), frame(spark, y), 2, 9)[0]) == plain(x, y, 2)


@pytest.mark.parametrize("tile", [1, 7, 1 << 20])
def test_tiles(monkeypatch, tile):
    """A group's best by tiles of any size, with ties and floors, as by all pairs at once."""
    import pyarrow as pa

    monkeypatch.setattr(N, "TILE", tile)
    rng = np.random.default_rng(8)
    x, y = (unit(rng.integers(-2, 3, (c, 3)) + 0.25) for c in (70, 50))
    floor = np.round(rng.choice([-2.0, 0.5, 1.0], 70), 9)
    targets = pa.table({"id": np.arange(70), "v": x.tolist(), "floor": floor})
    context = pa.table({"cid": np.arange(50), "cv": y.tolist(), "label": np.arange(50) % 3})
    found = N._best(4)(pa.concat_tables([targets[:30], targets[30:]]), context)
    wanted = {(i, j, s) for i, j, s in plain(x, y, 4) if s >= floor[i]}
    assert set(zip(*(found[c].to_pylist() for c in ("t", "near", "sim")), strict=True)) == wanted


def test_memory_of_a_group():
    """A group of many targets is not compared at once."""
    import tracemalloc

    import pyarrow as pa

    x = unit(np.random.default_rng(9).standard_normal((6000, 8)))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float64()))
    targets = pa.table({"id": np.arange(6000), "v": lists, "floor": np.full(6000, -2.0)})
    context = pa.table({"cid": np.arange(6000), "cv": lists, "label": np.zeros(6000, np.int64)})
    tracemalloc.start()
    found = N._best(3)(targets, context)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All pairs of 2,048 targets alone would take 98 MB.
    assert found.num_rows == 18_000 and most < 60e6


def test_no_rows(spark):
    some = frame(spark, unit(np.ones((3, 2))))
    for a, b in ((some, some.limit(0)), (some.limit(0), some)):
        found, _ = N.nearest(a, b, 2)
        assert found.count() == 0 and found.columns == ["t", "near", "label", "sim"]


@pytest.mark.parametrize("k,spare,rounds", [(1, 4, 200), (5, 8, 200), (12, 16, 5)])
def test_components(spark, k, spare, rounds):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 12)) * np.linspace(3, 0.5, 12) @ np.linalg.qr(rng.standard_normal((12, 12)))[0] + 7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id bigint, v array<double>").repartition(5)
    fit = L.low_rank_components(rows, "v", k, spare, rounds)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.abs(fit.variances - values[::-1][:k]).max() < 1e-6 * values[-1]
    assert np.abs(np.abs(np.sum(fit.components * vectors[:, ::-1].T[:k], axis=1)) - 1).max() < 1e-4
    made = {r["id"]: r["projected"] for r in L.project(rows, "v", fit).collect()}
    assert made[900] is None and np.abs(np.asarray([made[i] for i in range(400)]) - (x - fit.mean) @ fit.components.T).max() < 1e-9
    shown = np.asarray([r["projected"] for r in L.display_scaled(L.project(rows.where("v is not null"), "v", fit), "projected").collect()])
    assert shown.min() == 0 and shown.max() == 1


def test_component_samples_and_errors(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(v.tolist(),) for v in rng.standard_normal((3000, 4)) * [4, 2, 1, 1]], "v array<double>")
    fit = L.low_rank_components(rows, "v", 2, max_samples=1000)
    assert 850 < fit.rows < 1150 and abs(fit.variances[0] / 16 - 1) < 0.2
    assert L.low_rank_components(rows, "v", 2, max_samples=10**6).rows == 3000
    for bad in (rows.limit(1), rows.limit(0)):
        with pytest.raises(ValueError):
            L.low_rank_components(bad, "v", 1)
    for k in (0, 5):
        with pytest.raises(ValueError):
            L.low_rank_components(rows, "v", k)
    flat = L.low_rank_components(spark.createDataFrame([([1.0, 2.0],)] * 5, "v array<double>"), "v", 2)
    assert np.abs(flat.variances).max() < 1e-20


def test_triangles(spark):
    x = np.random.default_rng(6).standard_normal((500, 6))
    r = L.tall_qr(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(9), lambda m: m)
    assert np.abs(r.T @ r - x.T @ x).max() < 1e-9


def misread(text, codec):
    return "".join(bytes([b]).decode(codec, "strict") if codec != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())


CLEAN = ["plain", "", "naïve café, “école” — 10 €", "Straße, schön, ÄÖÜ", "¿Qué? ¡Sí! año", "Привет, мир", "日本語のテキスト", "αβγ", "😀 ok", "À la Ü°", "VOILÀ", "Èéç ßöö Èèê", "a b ½ ² ©2020 ™", "l’été", "«Oui»", "ÉCOLE DÉJÀ"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert R.repaired(text) == text


@pytest.mark.parametrize("codec", ["latin-1", "cp1252"])
@pytest.mark.parametrize("times", [1, 2, 3])
def test_damage_is_undone(codec, times):
    for text in CLEAN:
        worse = text
        for _ in range(times):
            worse = misread(worse, codec)
        assert R.repaired(worse) == text, worse


@pytest.mark.parametrize("codec", ["mac_roman", "cp437"])
def test_damage_of_old_tables(codec):
    for text in ("café à la carte, schön", "l’été “école” — 10 €", "über naïve Größe"):
        assert R.repaired(misread(text, codec)) == text


def test_damage_in_parts():
    rng = random.Random(2)
    words = ["café", "größe", "plain", "l’été", "año", "naïve", "word", "“so”"]
    for _ in range(300):
        chosen = [rng.choice(words) for _ in range(12)]
        mixed = " ".join(misread(w, rng.choice(["latin-1", "cp1252"])) if rng.random() < 0.5 else w for w in chosen)
        assert R.repaired(mixed) == " ".join(chosen)
        assert R.repaired(R.repaired(mixed)) == R.repaired(mixed)


def test_fixed_forms(spark):
    cases = [("ﬁn ‘a’ “b”", "fin 'a' \"b\""), ("Ａｂ１　x", "Ab1 x"), ("a\r\nb\rc", "a\nb\nc"), ("\x1b[31mred\x1b[0m", "red"), ("a\x00b\x07﻿", "ab"), ("é", "é"), ("schÃ¶n â€œsoâ€\x9d", 'schön "so"'), ("", "")]
    for text, want in cases:
        assert R.fixed(text) == want
    rows = spark.createDataFrame([*cases, (None, None)], "a string, b string")
    assert rows.select(R.fixed_text(F.col("a")).eqNullSafe(F.col("b")).alias("same")).where("not same").count() == 0
    assert rows.select(R.repaired_text(F.col("a")).alias("x")).where("x is null").count() == 1


def test_one_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = (unit(rng.integers(-2, 3, (c, 4)) + 0.25) for c in (50, 90))
    monkeypatch.setattr(N, "TARGETS", 9)
    found, share = N.nearest(frame(spark, x), frame(spark, y), 5)
    assert got(found) == plain(x, y, 5) and share == 1.0

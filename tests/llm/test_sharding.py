"""The hypergeometric shuffle: exact sizes, gapless slots, laws of the draws, and edge cases."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries, sharding


def placed(frame, **options):
    by = collections.defaultdict(list)
    for r in sharding.place_rows(frame, **options).collect():
        by[r["shard"]].append(r["slot"])
    return by


@pytest.mark.parametrize("n,parts,bits", [(0, 2, 16), (1, 1, 16), (7, 3, 16), (1000, 5, 4), (2401, 3, 7)])
def test_sizes_and_slots(spark, n, parts, bits):
    by = placed(spark.range(0, n, 1, parts), shards=24, block_bits=bits)
    assert {s: len(v) for s, v in by.items()} == {s: size for s, size in enumerate(sharding.shard_sizes(n, 24)) if size}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_rows_stay_whole(spark):
    rows = [(1, None, "a", 5), (1, "", "b", 6), (None, "x" * 100000, "c", 7), (None, None, None, None), (2, "same", "d", 8), (2, "same", "d", 8)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, Shard string, at int")
    out = sharding.place_rows(frame, 4, seed=3)
    assert out.columns == ["doc_id", "text", "at", "shard", "slot"]
    assert sorted(((r["doc_id"], r["text"], r["at"]) for r in out.collect()), key=repr) == sorted(((a, b, d) for a, b, _, d in rows), key=repr)
    with pytest.raises(ValueError):
        sharding.place_rows(frame, 0)


def test_reruns_agree_and_seeds_differ(spark):
    frame = spark.range(0, 500, 1, 4)
    at = lambda seed: sorted(tuple(r) for r in sharding.place_rows(frame, 5, seed=seed, block_bits=5).collect())
    one = at(1)
    assert one == at(1) and one != at(2)


def test_uniform(spark):
    """Over many seeds each row falls in each shard and slot alike, and neighbours part as often as chance says."""
    n, shards, runs = 48, 4, 24
    frame = spark.range(0, n, 1, 3)
    where, slots, together = np.zeros((n, shards)), np.zeros((n, n // shards)), 0
    for seed in range(runs):
        found = {r["id"]: (r["shard"], r["slot"]) for r in sharding.place_rows(frame, shards, seed=seed, block_bits=3).collect()}
        for k, (s, t) in found.items():
            where[k, s] += 1
            slots[k, t] += 1
        together += sum(found[k][0] == found[k + 1][0] for k in range(0, n, 2))
    # Chi-square sums of many cells lie within five deviations of their mean.
    for table in (where, slots):
        expected = runs / table.shape[1]
        chi, freedom = ((table - expected) ** 2 / expected).sum(), n * (table.shape[1] - 1)
        assert abs(chi - freedom) < 5 * (2 * freedom) ** 0.5
    chance = (n / shards - 1) / (n - 1)
    assert abs(together / (runs * n / 2) - chance) < 5 * (chance * (1 - chance) / (runs * n / 2)) ** 0.5


def test_hypergeometric_beyond_numpy(monkeypatch):
    good, bad, n, runs = 300, 500, 200, 20000
    monkeypatch.setattr(sharding, "NUMPY_MOST", 0)
    rng = np.random.default_rng(1)
    own = np.asarray([sharding.hypergeometric(rng, good, bad, n) for _ in range(runs)])
    other = np.random.default_rng(2).hypergeometric(good, bad, n, runs)
    assert abs(own.mean() - 75) < 0.25 and abs(own.var() / other.var() - 1) < 0.06
    a, b = (np.bincount(x, minlength=n + 1) for x in (own, other))
    assert (np.abs(np.cumsum(a) - np.cumsum(b)) / runs).max() < 0.025
    big = [sharding.hypergeometric(rng, 10**12, 23 * 10**12, 10**8) for _ in range(300)]
    mean, deviation = 10**8 / 24, (10**8 * (1 / 24) * (23 / 24)) ** 0.5
    assert abs(np.mean(big) - mean) < 5 * deviation / 300**0.5 and 0.85 < np.std(big) / deviation < 1.15
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 2, 2, 4) == 2


def test_matrix_has_both_sums(spark):
    rows = spark.range(0, 5000, 1, 7).withColumn("block", F.col("id") % 37)
    matrix, count = sharding._matrix(rows, 6, 9)
    lines = {r["block"]: np.diff([0, *r["upto"]]) for r in matrix.collect()}
    assert count == 5000 and len(lines) == 37
    assert {b: int(x.sum()) for b, x in lines.items()} == {b: len(range(b, 5000, 37)) for b in range(37)}
    assert sum(lines.values()).tolist() == sharding.shard_sizes(5000, 6)


def test_write_shards(spark, tmp_path):
    frame = spark.range(0, 300, 1, 3).withColumn("text", F.concat(F.lit("t"), "id"))
    sharding.write_shards(frame, str(tmp_path / "out"), 3, block_bits=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 100, 1: 100, 2: 100}
    assert sorted(r["text"] for r in back.collect()) == sorted(f"t{k}" for k in range(300))


def test_op12(spark, sf_dir):
    rows = queries.op12_uniform_shards(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in queries.read(spark, sf_dir, "documents").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()}
    counts = collections.Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all({r["slot"] for r in rows if r["shard"] == s} == set(range(n)) for s, n in counts.items())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}

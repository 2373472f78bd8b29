import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions.splits import is_validation, threshold_hex
from gridloom.operators import features as V
from gridloom.operators import grids as G
from gridloom.operators import metrics as M
from gridloom.operators import shards as S
from gridloom.sources.shards import ShardSource, resolve
from gridloom.streaming import resume


def write_tar(path, members):
    with tarfile.open(path, "w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def pairs(*keys):
    return [m for k in keys for m in ((f"{k}.jpg", b"\xff" + k.encode()), (f"{k}.json", json.dumps({"k": k}).encode()))]


def test_tar_shards(spark, tmp_path):
    write_tar(tmp_path / "b.tar", [*pairs("sa_3"), ("notes.txt", b"x")])
    write_tar(tmp_path / "a.tar", pairs("sa_1", "sa_2"))
    spark.dataSource.register(ShardSource)
    rows = spark.read.format("tarshards").load(str(tmp_path)).collect()
    assert sorted(r["key"] for r in rows) == ["sa_1", "sa_2", "sa_3"]
    assert [os.path.basename(p) for p in resolve(str(tmp_path))] == ["a.tar", "b.tar"]
    with pytest.raises(ValueError):
        resolve(str(tmp_path / "none"))


@pytest.mark.parametrize("members", [pairs("sa_1")[:1], [*pairs("sa_1")[:1], *pairs("sa_2")], [pairs("sa_1")[0]] * 2])
def test_tar_errors(spark, tmp_path, members):
    write_tar(tmp_path / "x.tar", members)
    spark.dataSource.register(ShardSource)
    with pytest.raises(Exception, match="incomplete|twice"):
        spark.read.format("tarshards").load(str(tmp_path)).collect()


def test_stream_exactly_once(spark, tmp_path):
    source, out, place = (str(tmp_path / n) for n in ("in", "out", "place"))
    spark.range(10).write.parquet(source)
    for more in (0, 10):
        if more:
            spark.range(10, 20).write.mode("append").parquet(source)
        resume.write_once(resume.stream_shards(spark, source, "id bigint", 2), out, place)
    assert sorted(r["id"] for r in spark.read.parquet(out).select("id").collect()) == list(range(20))


def test_running_accuracy(spark, tmp_path):
    """Counts go on over runs of the same checkpoint and start anew with each epoch."""
    where, out, place = (str(tmp_path / n) for n in ("p", "out", "place"))
    for rows in ([(0, 1, 1), (0, 2, 1), (0, 3, 3), (0, 4, 4)], [(0, 1, 2), (1, 5, 5)]):
        spark.createDataFrame(rows, "epoch int, label int, pred int").write.mode("append").parquet(where)
        resume.running_accuracy(spark.readStream.schema("epoch int, label int, pred int").parquet(where), out, place)
    got = {r["epoch"]: (r["n"], r["accuracy"]) for r in spark.read.parquet(out).collect()}
    assert got == {0: (5, 0.6), 1: (1, 1.0)}


def test_split_properties(spark):
    rows = spark.range(4000).withColumn("v", is_validation(F.col("id"), 0.05, 42)).withColumn("w", is_validation(F.col("id"), 0.05, 7))
    n, both = rows.where("v").count(), rows.where("v and w").count()
    assert 120 < n < 280 and both < n
    assert threshold_hex(0.05) == "0cccccccccccccc0" and threshold_hex(0.2) == "3333333333333300"
    with pytest.raises(ValueError):
        threshold_hex(1.0)


def test_slices_cover_once(spark):
    rows = spark.range(160).withColumnRenamed("id", "ordinal")
    for world in (1, 2, 4):
        got = rows.withColumn("w", S.slice_of(F.col("ordinal"), 0, 160, 2, world * 3)).groupBy("w").count().collect()
        assert sum(r["count"] for r in got) == 160 and all(0 <= r["w"] < world * 3 and r["count"] % 2 == 0 for r in got)


def test_equal_shards_remainder(spark):
    rows = spark.range(5).withColumn("g", F.lit(0))
    assert S.equal_shards(rows, "g", ["id"], 2).count() == 4
    assert S.equal_shards(rows, "g", ["id"], 2, True).count() == 5


def test_sequential_pull_compounds(spark):
    v = spark.createDataFrame([(1, p, [float(p)]) for p in range(3)], "image bigint, pixel bigint, v array<double>")
    m = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 2)], "image bigint, mask bigint, pixel bigint")
    got = {r["pixel"]: r["v"][0] for r in V.sequential_pull(v, m, 0.8).collect()}
    a, b = 0.2 * 0 + 0.8 * 0.5, 0.2 * 1 + 0.8 * 0.5
    mean = (b + 2) / 2
    assert got == pytest.approx({0: a, 1: 0.2 * b + 0.8 * mean, 2: 0.2 * 2 + 0.8 * mean})


def test_affinity_degenerate(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0], [0.0, 0.0]), (0, [1.0, 0.0], [1.0, 0.0])], "g int, a array<double>, b array<double>")
    assert V.affinity_gram(rows, "g", "a", "b").collect()[0]["mse"] == pytest.approx(0.0, abs=1e-9)


def test_empty_union_is_one(spark):
    rows = spark.createDataFrame([(0, False, False), (1, True, False)], "f int, truth boolean, pred boolean")
    assert {r["f"]: r["j"] for r in M.region_j(rows, ["f"]).collect()} == {0: 1.0, 1: 0.0}


def test_hungarian_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        c = rng.random((n, int(rng.integers(n, 6))))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(c.shape[1]), n))
        assert sum(c[i, j] for i, j in enumerate(M.hungarian(c))) == pytest.approx(best)


def test_band_join_once(spark):
    g = spark.range(400).select(F.lit(0).alias("k"), (F.col("id") % 20).alias("r"), F.floor(F.col("id") / 20).alias("c"), "id")
    pairs = G.band_join(g, g, 2, "k")
    assert pairs.count() == pairs.distinct().count() == sum(1 for a in range(400) for b in range(400) if abs(a % 20 - b % 20) <= 2 and abs(a // 20 - b // 20) <= 2)


def test_runs_start_with_zero(spark):
    m = spark.createDataFrame([(0, r, c, True) for r in range(2) for c in range(2)], "image int, r int, c int, m boolean")
    runs = G.run_lengths(m, 2)
    assert runs.collect()[0]["counts"] == [0, 4] and G.decode_runs(runs, 2).count() == 4


def test_context_packing(spark):
    rows = spark.createDataFrame([([1, 2],), (list(range(100)),)], "ids array<int>")
    a, b = (r[0] for r in rows.select(X.pack_context(F.col("ids"), 7, 9, 5)).collect())
    assert a == [7, 1, 2, 9, 0] and b == [7, 0, 1, 2, 9]


def test_ema_copies_first(spark):
    rows = spark.createDataFrame([(0, i, float(i)) for i in range(4)], "g int, i int, x double")
    got = V.ema(rows, "g", "i", "x", 0.5, every=1, after=1).collect()[0]["ema"]
    assert got == pytest.approx(2.25)


def test_latest_breaks_ties_by_path(spark):
    rows = spark.createDataFrame([(0, "a", 5), (0, "b", 5), (0, "z", 1)], "g int, p string, t int")
    assert S.latest(rows, "g", "p", "t").collect()[0]["p"] == "b"


def test_code_tables_are_those_of_the_standard():
    import html

    from gridloom.functions.text import forbidden_codes, moved_codes

    assert moved_codes() == html._invalid_charrefs and set(forbidden_codes()) == html._invalid_codepoints


def test_own_merges_are_the_library_s(spark):
    """All words of documents, and odd ones, by the merges and by the tokenizers library."""
    from tokenizers import Tokenizer

    from gridloom.sources.wordpiece import Merges, default_vocabulary, encode_words

    library = Tokenizer.from_str(default_vocabulary())
    library.encode_special_tokens = True
    texts = ["", "   ", "a", "aaaa aaaaa", "The quick brown fox's 1234 jumps!!! over", "naïve café — ½", "привет мир", "日本語", "😀😀 ok", "don't can't we'll", "x" * 300, "supercalifragilistic" * 3, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: list(r["ids"]) for r in encode_words(rows, "id", "text").collect()}
    assert got == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    merges = Merges(default_vocabulary())
    assert merges.merged("aaaaa") == [library.id_to_token(i) for i in library.encode("aaaaa", add_special_tokens=False).ids]


def test_words_in_bounded_parts(monkeypatch):
    """Runs of rows hold a bounded number of words, or one long text; ids are those of the words one by one."""
    import pyarrow as pa

    from gridloom.sources import wordpiece as B

    monkeypatch.setattr(B, "ITEMS", 5)
    rows = [["the", "cat"], None, [], ["a"] * 9, ["the"], ["sat", "naïve", "zzxqy", "the"], ["cat", "x" * 40], None, ["😀"]]
    merges = B.Merges(B.default_vocabulary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([["left", "out"], *rows], pa.list_(pa.string()))], names=["id", "words"]).slice(1)
    cut = list(B.parts(batch, 1))
    assert [i for b in cut for i in b.column(0).to_pylist()] == list(range(1, 10))
    assert all(b.num_rows == 1 or sum(len(w or ()) for w in b.column(1).to_pylist()) <= 5 for b in cut) and len(cut) == 4
    assert [ids for b in cut for ids in merges.lists(b.column(1)).to_pylist()] == [[i for w in r or () for i in merges.of(w)] for r in rows]
    assert list(B.parts(batch.slice(0, 0), 1)) == [] and merges.lists(batch.slice(0, 0).column(1)).to_pylist() == []


def test_centre_square(spark):
    import numpy as np

    from gridloom.operators import grids as G

    rng = np.random.default_rng(1)
    for h, w, side in ((9, 14, 6), (14, 9, 6), (8, 8, 8)):
        x = rng.random((h, w))
        rows = spark.createDataFrame([(0, r, c, float(x[r, c])) for r in range(h) for c in range(w)], "image int, r int, c int, x double")
        nh, nw = (side, side * w // h) if h <= w else (side * h // w, side)
        top, left = round((nh - side) / 2), round((nw - side) / 2)
        got = {(r["r"], r["c"]): r["x"] for r in G.centre_square(rows, h, w, side, labels=True).collect()}
        assert got == {(r, c): x[int((r + top) * h / nh), int((c + left) * w / nw)] for r in range(side) for c in range(side)}
        assert len(G.centre_square(rows, h, w, side).collect()) == side * side

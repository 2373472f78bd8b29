"""Streams of pairs and shards, the shard writer's commits, label images and array archives."""

import json
import os
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.plans import catalogue  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES
from gridloom.sinks import shards as K
from gridloom.sources import arrays, stores
from gridloom.sources import label_images as I
from gridloom.sources.arrays import ArraySource
from gridloom.sources.npz_sink import write_arrays
from gridloom.sources.shard_stream import ShardStream, ShardStreamReader
from gridloom.streaming import pairs as P
from tests.support.compare import check
from tests.test_scans import samples

MEMBERS = "name string, kind string, payload binary"


def arrive(spark, folder, *batches):
    for batch in batches:
        rows = [(n, k, bytes(p, "utf-8") if p is not None else None) for n, k, p in batch]
        spark.createDataFrame(rows, MEMBERS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(MEMBERS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_pairs_across_batches(spark, tmp_path):
    stream = arrive(spark, f"{tmp_path}/in", [("a", "jpg", "1"), ("b", "json", "2"), ("c", "jpg", "3")], [("b", "jpg", "4"), ("a", "jpg", "again"), ("d", "json", "9")], [("a", "json", "5"), ("b", "json", "late"), ("d", "jpg", "8")])
    report = P.write_pairs(stream, f"{tmp_path}/out", f"{tmp_path}/place", ["name"])
    assert report == {"batches": 3, "left": 1, "most_held": 3}
    rows = lambda: sorted((r["name"], bytes(r["jpg"]).decode(), bytes(r["json"]).decode()) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows() == [("a", "1", "5"), ("b", "4", "2"), ("d", "8", "9")]
    assert [tuple(r) for r in P.halves_left(spark, f"{tmp_path}/place").collect()] == [("c", "jpg", 1)]
    # A later run goes on from the state: the half that was left finds its partner, an old half's copy finds none.
    stream = arrive(spark, f"{tmp_path}/in", [("c", "json", "6"), ("a", "jpg", "x")])
    assert P.write_pairs(stream, f"{tmp_path}/out", f"{tmp_path}/place", ["name"], complete=True)["left"] == 0
    assert rows() == [("a", "1", "5"), ("b", "4", "2"), ("c", "3", "6"), ("d", "8", "9")]


def test_pairs_that_fail(spark, tmp_path):
    with pytest.raises(ValueError, match="1 halves without a partner.*'a'"):
        P.write_pairs(arrive(spark, f"{tmp_path}/1", [("a", "jpg", "1")]), f"{tmp_path}/o1", f"{tmp_path}/p1", ["name"], complete=True)
    for k, (batch, options, message) in enumerate((([("a", "jpg", "1"), ("a", "jpg", "2")], {"repeated": "error"}, "comes twice"), ([("a", "png", "1")], {}, "no half"), ([("a", "jpg", None)], {}, "is empty"))):
        with pytest.raises(Exception, match=message):
            P.write_pairs(arrive(spark, f"{tmp_path}/f{k}", batch), f"{tmp_path}/of{k}", f"{tmp_path}/pf{k}", ["name"], **options)
    with pytest.raises(ValueError):
        P.paired_stream(arrive(spark, f"{tmp_path}/x", [("a", "jpg", "1")]), ["name"], repeated="perhaps")


def test_streamed_equals_batch(spark, tmp_path):
    rows = [(f"k{i}", kind, f"{kind}{i}") for i in range(60) for kind in ("jpg", "json") if not (i % 7 == 0 and kind == "json")]
    np.random.default_rng(1).shuffle(rows)
    stream = arrive(spark, f"{tmp_path}/in", rows[:40], rows[40:80], rows[80:])
    P.write_pairs(stream, f"{tmp_path}/out", f"{tmp_path}/place", ["name"])
    got = {r["name"]: bytes(r["json"]).decode() for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {f"k{i}": f"json{i}" for i in range(60) if i % 7}


def test_stream_of_passes(spark, tmp_path):
    folder = f"{tmp_path}/shards"
    K.write_shards(samples(spark, 23), folder, 5, keep_remainder=True)
    spark.dataSource.register(ShardStream)

    def start():
        source = spark.readStream.format("tarshardstream").options(quota=60, step=8, progress=f"{tmp_path}/progress.json", seed=4).load(folder)
        return source.select("pass", "position", "key").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/place").start(f"{tmp_path}/out")

    one = start()
    until = time.time() + 60
    while not (one.lastProgress and one.lastProgress["batchId"] >= 2) and time.time() < until:
        time.sleep(0.05)
    one.stop()
    some = spark.read.parquet(f"{tmp_path}/out").count()
    assert 8 <= some < 60
    two = start()
    two.processAllAvailable()
    assert "'pass': 2, 'shard': 3, 'place': 1" in str(two.lastProgress["sources"][0]["endOffset"]).replace('"', "'")
    two.stop()
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("position", "pass", "key").collect())
    assert [r[0] for r in rows] == list(range(60))
    for turn in (0, 1):
        own = [k for _, t, k in rows if t == turn]
        assert sorted(own) == sorted(f"sa_{i}" for i in range(23))
    # Passes have orders of their own, shard by shard.
    assert [k for _, t, k in rows if t == 0] != [k for _, t, k in rows if t == 1]


def test_offsets(spark, tmp_path):
    folder = str(tmp_path)
    K.write_shards(samples(spark, 13), folder, 5, keep_remainder=True)
    reader = ShardStreamReader({"path": folder, "quota": "40"})
    for p in range(41):
        assert reader.position(reader.offset(p)) == p
    assert reader.offset(13) == {"pass": 1, "shard": 0, "place": 0} and reader.latestOffset() == reader.offset(40)
    pieces = reader.partitions(reader.offset(3), reader.offset(16))
    assert [(os.path.basename(x.url), x.turn, x.begin, x.end, x.position) for x in pieces] == [("shard-000000.tar", 0, 3, 5, 3), ("shard-000001.tar", 0, 0, 5, 5), ("shard-000002.tar", 0, 0, 3, 10), ("shard-000000.tar", 1, 0, 3, 13)]
    for bad in ({"quota": "0"}, {"step": "0"}, {"path": str(tmp_path / "none")}):
        with pytest.raises(ValueError):
            ShardStreamReader({"path": folder} | bad)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    K.write_shards(samples(spark, 10), folder, 5)
    state = stores.load_state(f"{folder}/state.json")
    broken = samples(spark, 30).withColumn("jpg", F.when(F.col("ordinal") == 22, F.raise_error(F.lit("lost"))).otherwise(F.col("jpg")))
    with pytest.raises(Exception, match="lost"):
        K.write_shards(broken, folder, 5)
    assert sorted(os.listdir(folder)) == ["shard-000000.tar", "shard-000001.tar", "state.json"] and stores.load_state(f"{folder}/state.json") == state
    assert len(K.write_shards(samples(spark, 30), folder, 5)["shards"]) == 6


def test_gaps_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="gaps"):
        K.write_shards(samples(spark, 30).where("ordinal <> 7"), str(tmp_path / "out"), 5)
    assert not [f for f in os.listdir(tmp_path / "out") if f != "state.json"]


def test_a_commit_is_ended_by_the_next_run(spark, tmp_path, monkeypatch):
    """The driver dies after it wrote down the commit and moved one file."""
    folder = str(tmp_path / "out")
    written = {}

    def die(place):
        written.update(stores.load_state(f"{place}/commit.json"))
        stores.move(*written["moves"][0])
        raise RuntimeError("gone")

    writer = K.ShardWriter({"path": folder, "per_shard": "2", "state": json.dumps(K.checked_state(None, {}, [], 2))})
    import pyarrow as pa

    rows = {"shard": [0, 0, 1, 1], "ordinal": [0, 1, 2, 3], "key": list("abcd"), "jpg": [b"1"] * 4, "json": [b"{}"] * 4}
    message = writer.write(iter(pa.table(rows).to_batches()))
    monkeypatch.setattr(K, "recover", die)
    with pytest.raises(RuntimeError):
        writer.commit([message, None])
    monkeypatch.undo()
    assert "state.json" not in os.listdir(folder) and "commit.json" in os.listdir(folder)
    assert K.recover(folder) and not K.recover(folder)
    assert sorted(os.listdir(folder)) == ["shard-000000.tar", "shard-000001.tar", "state.json"]
    assert [s["samples"] for s in stores.load_state(f"{folder}/state.json")["shards"]] == [2, 2]


def test_repeated_attempts_do_not_meet(tmp_path):
    import pyarrow as pa

    folder = str(tmp_path)
    writer = K.ShardWriter({"path": folder, "per_shard": "2", "state": json.dumps(K.checked_state(None, {}, [], 2))})
    rows = {"shard": [0, 0], "ordinal": [0, 1], "key": ["a", "b"], "jpg": [b"1"] * 2, "json": [b"{}"] * 2}
    lost, kept = (writer.write(iter(pa.table(rows).to_batches())) for _ in range(2))
    assert lost.shards[0]["file"] != kept.shards[0]["file"]
    writer.commit([kept])
    assert sorted(os.listdir(folder)) == ["shard-000000.tar", "state.json"]


def test_old_states_are_taken_over(spark, tmp_path):
    folder = str(tmp_path / "out")
    K.write_shards(samples(spark, 10), folder, 5, {"size": 1024}, ["one"])
    state = stores.load_state(f"{folder}/state.json")
    old = {"version": 1, "configuration": {"size": 1024, "target_mb": 500, "calibration_samples": 64, "sources": ["one"], "samples_per_shard": None}, "cursor": [1, 77], "samples_per_shard": None, "shards": state["shards"], "finished": True}
    stores.save_state(f"{folder}/state.json", old)
    new = K.write_shards(samples(spark, 17), folder, 5, {"size": 1024}, ["one", "two"])
    assert (new["version"], new["legacy_source"], new["samples_per_shard"], len(new["shards"]), new["sources"]) == (2, 1, 5, 3, ["one", "two"])
    stores.save_state(f"{folder}/state.json", old | {"configuration": {"size": 512, "sources": ["one"]}})
    with pytest.raises(ValueError):
        K.write_shards(samples(spark, 17), folder, 5, {"size": 1024}, ["one"])


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
@pytest.mark.parametrize("rule", [None, 0, 1, 2, 3, 4])
def test_images_round_trip(depth, rule):
    rng = np.random.default_rng(depth)
    for h, w in ((1, 1), (3, 7), (9, 16), (6, 13)):
        x = rng.integers(0, 1 << depth, (h, w))
        back, palette, bits = I.decoded(I.encoded(x, bytes(range(30)), depth, rule))
        assert (back == x).all() and palette == bytes(range(30)) and bits == depth


def test_broken_images():
    good = I.encoded(np.arange(12).reshape(3, 4), bytes(36))
    for bad in (b"", good[:-5], good[:40], b"x" + good[1:], good[:50] + bytes([good[50] ^ 1]) + good[51:]):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            I.decoded(bad)
    for x, depth in ((np.zeros((0, 3), int), 8), (np.full((2, 2), 4), 2), (np.full((2, 2), -1), 8), (np.zeros(4, int), 8)):
        with pytest.raises(ValueError):
            I.encoded(x, b"", depth)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    for colour, depth, lace in ((2, 8, 0), (3, 16, 0), (3, 8, 1), (3, 8, 0)):
        head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, depth, colour, 0, 0, lace))
        with pytest.raises(ValueError):
            I.decoded(I.SIGNATURE + head + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b""))


def test_image_folders(spark, tmp_path):
    rows = [(s, f"{t:05d}", r, c, (t + r * c) % 4 if (r, c) != (1, 1) else I.VOID) for s in ("cat", "dog") for t in range(2) for r in range(3) for c in range(4)]
    pixels = spark.createDataFrame(rows, "sequence string, frame string, r int, c int, label int")
    folder = str(tmp_path / "labels")
    assert I.write_label_images(pixels, folder, bytes(768)).count() == 4
    assert sorted(os.listdir(folder)) == ["cat", "dog"] and os.listdir(f"{folder}/cat") != []
    images = I.label_images(spark, folder)
    assert sorted(tuple(r) for r in I.pixels_of(images).collect()) == sorted(rows)
    assert {(r["height"], r["width"], r["depth"], r["colours"]) for r in images.collect()} == {(3, 4, 8, 256)}
    assert I.label_images(spark, folder, ["dog"]).count() == 2
    masks = I.object_masks(I.pixels_of(images)).where("is_void").collect()
    assert len(masks) == 4 and {(m["r"], m["c"], m["object"]) for m in masks} == {(1, 1, 0)}
    with pytest.raises(ValueError, match="dog/00007"):
        I.read_results(spark, folder, spark.createDataFrame([("dog", "00007"), ("cat", "00000")], "sequence string, frame string"))
    with open(f"{folder}/cat/00001.png", "r+b") as f:
        f.seek(60)
        f.write(b"zz")
    with pytest.raises(Exception, match="cat/00001.png"):
        I.label_images(spark, folder).collect()
    with pytest.raises(Exception, match="missing or come twice"):
        I.write_label_images(pixels.where("r <> 1"), str(tmp_path / "holes"), bytes(768)).collect()


def test_first_segmentation_sizes(spark, tmp_path):
    x = np.arange(8 * 16).reshape(8, 16) % 5
    pixels = spark.createDataFrame([("a", "00003", r, c, int(x[r, c])) for r in range(8) for c in range(16)], "sequence string, frame string, r int, c int, label int")
    I.write_label_images(pixels, str(tmp_path), bytes(768)).collect()
    soft = I.first_segmentation(I.label_images(spark, str(tmp_path)), 16).collect()
    # The shorter side of 224 and the longer of 448 in patches of 16.
    assert len(soft) == 14 * 28
    for s in soft:
        assert s["soft"].index(1.0) == x[int((s["r"] + 0.5) * 8 / 14), int((s["c"] + 0.5) * 16 / 28)]


def ragged(folder, n):
    """Vectors of which the last frame of 100 has only some."""
    rows = pa.table({"vec_id": np.arange(n), "embedding": [[1.0]] * n, "label": pa.array(np.arange(n) * 7 % 10, pa.int32())})
    pq.write_table(rows, f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("n", [505, 564, 1956])
def test_first_segmentations_of_ragged_frames(spark, tmp_path, n):
    folder = ragged(tmp_path, n)
    assert check(QUERIES["first_segmentations"](spark, folder), ORACLES["first_segmentations"], folder) > 0


@pytest.mark.parametrize("n", [505, 564, 1956])
def test_label_images_of_ragged_frames(spark, tmp_path, n):
    folder = ragged(tmp_path, n)
    assert check(QUERIES["label_image_roundtrip"](spark, folder), ORACLES["label_image_roundtrip"], folder) == n


def test_holes_of_images(spark, tmp_path):
    rows = [("a", "00000", 1, 2, 7), ("a", "00000", 2, 0, I.VOID), ("b", "00000", 0, 0, 0)]
    pixels = spark.createDataFrame(rows, "sequence string, frame string, r int, c int, label int")
    I.write_label_images(pixels, str(tmp_path / "x"), bytes(768), size=(3, 5)).collect()
    images = I.label_images(spark, str(tmp_path / "x"))
    assert {(i["height"], i["width"], i["holes"].count(0)) for i in images.collect()} == {(3, 5, 2), (3, 5, 1)}
    assert sorted(tuple(r) for r in I.pixels_of(images).collect()) == sorted(rows)
    for wrong in (pixels.unionAll(pixels), pixels.withColumn("c", F.col("c") + 3)):
        with pytest.raises(Exception, match="come twice|outside of"):
            I.write_label_images(wrong, str(tmp_path / "y"), bytes(768), size=(3, 5)).collect()


@pytest.mark.parametrize("packed", [False, True])
def test_array_archives(spark, tmp_path, packed):
    rng = np.random.default_rng(2)
    feats, labels, imgs = rng.standard_normal((500, 6)).astype("<f4"), rng.integers(0, 9, 500), rng.integers(0, 255, (500, 2, 3)).astype(np.uint8)
    path = str(tmp_path / "f.npz")
    (np.savez_compressed if packed else np.savez)(path, feats=feats, labels=labels, imgs=imgs)
    spark.dataSource.register(ArraySource)
    rows = spark.read.format("npz").options(arrays="feats,labels,imgs", rows_per_partition=64, num_limit=333).load(path)
    assert rows.rdd.getNumPartitions() == 6
    got = rows.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(333)) and dict(rows.dtypes)["imgs"] == "array<smallint>"
    assert np.array_equal(np.asarray([r["feats"] for r in got], np.float32), feats[:333]) and [r["labels"] for r in got] == labels[:333].tolist()
    assert np.array_equal(np.asarray([r["imgs"] for r in got]), imgs.reshape(500, 6)[:333])
    assert spark.read.format("npz").load(path).columns == ["row", "feats", "labels"]


def test_broken_archives(tmp_path):
    path = str(tmp_path / "f.npz")
    np.savez(path, feats=np.zeros((3, 2)), labels=np.zeros(4), order=np.asfortranarray(np.zeros((3, 2))), words=np.asarray(["a"]), one=np.float64(1))
    for name in ("none", "order", "one"):
        with pytest.raises(ValueError):
            arrays.ArrayFile(path, name)
    with pytest.raises(ValueError):
        arrays.field_of(arrays.ArrayFile(path, "words"))
    with pytest.raises(ValueError, match="several lengths"):
        ArraySource({"path": path}).reader(None)
    (tmp_path / "x.npz").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        arrays.ArrayFile(str(tmp_path / "x.npz"), "feats")


def test_written_archives_are_whole(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).select((999 - F.col("id")).alias("id"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("feats"))
    path = str(tmp_path / "w.npz")
    assert write_arrays(rows, path, ["id"], {"feats": "<f4", "id": "<i8"}) == 1000
    with np.load(path) as found:
        assert found["id"].tolist() == list(range(1000)) and found["feats"].dtype == np.float32
        assert np.array_equal(found["feats"][:, 0], 999 - np.arange(1000))
    assert zipfile.ZipFile(path).testzip() is None and os.listdir(tmp_path) == ["w.npz"]
    assert arrays.ArrayFile(path, "feats").shape == (1000, 2)
    with pytest.raises(Exception, match="nulls"):
        write_arrays(spark.createDataFrame([(1, None)], "id bigint, feats array<float>"), path + "2", ["id"], {"feats": "<f4"})
    assert write_arrays(rows.limit(0), str(tmp_path / "e.npz"), ["id"], {"id": "<i8"}) == 0

"""Folders, list files, manifests, shards, loaders and registries on real files."""

import hashlib
import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.operators import features as V
from gridloom.operators import grids as G
from gridloom.operators import loaders as L
from gridloom.operators import metrics as M
from gridloom.operators import streams as T
from gridloom.sinks import shards as K
from gridloom.sources import registry as R
from gridloom.sources import scans as C
from gridloom.sources import stores
from gridloom.sources.shards import ShardSource, resolve
from gridloom.sources.wordpiece import decode_words, default_vocabulary, encode_words


def touch(root, *names, data=b"x"):
    for n in names:
        path = root / n
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def test_pair_directory(spark, tmp_path):
    touch(tmp_path, *[f"sa_{i}.jpg" for i in range(41)], *[f"sa_{i}.json" for i in range(40)])
    parts = {s: {os.path.basename(r["path"]) for r in R.dataset(spark, "sa1b", str(tmp_path), s).collect()} for s in ("train", "val")}
    assert (len(parts["train"]), len(parts["val"])) == (38, 2) and not parts["train"] & parts["val"] and "sa_40.jpg" not in parts["train"] | parts["val"]
    other = {os.path.basename(r["path"]) for s in ("train", "val") for r in R.dataset(spark, "sa1b", str(tmp_path), s, seed=7, sample_size=10).collect()}
    assert len(other) == 10
    for bad in ({"split": "test"}, {"split": "val", "val_fraction": 1.0}, {"split": "val", "sample_size": 1}):
        with pytest.raises(ValueError):
            C.split_pairs(spark.createDataFrame([("a", "a.jpg")], "stem string, path string"), **bad)
    with pytest.raises(ValueError):
        R.dataset(spark, "none", str(tmp_path), "val")


def test_list_and_city_scans(spark, tmp_path):
    touch(tmp_path, "cocostuff/curated/train2017/l.txt", data=b"a1 \nb2\n")
    touch(tmp_path, "cocostuff/curated/val2017/l.txt", data=b"c3\n")
    rows = R.dataset(spark, "cocostuff", str(tmp_path), "train+val", list_file="l.txt").collect()
    assert sorted(os.path.relpath(r["image"], tmp_path) for r in rows) == ["cocostuff/images/train2017/a1.jpg", "cocostuff/images/train2017/b2.jpg", "cocostuff/images/val2017/c3.jpg"]
    assert R.dataset(spark, "cocostuff", str(tmp_path), "val", list_file="l.txt").first()["label"].endswith("annotations/val2017/c3.png")
    touch(tmp_path, "cityscapes/leftImg8bit/train/x/a_1.png", "cityscapes/leftImg8bit/val/y/b.png", "cityscapes/leftImg8bit/val/deep.png")
    city = R.dataset(spark, "cityscapes", str(tmp_path), "train+val").collect()
    assert sorted(os.path.basename(r["label"]) for r in city) == ["a_1_labelTrainIds.png", "b_labelTrainIds.png"] and all("gtFine" in r["label"] for r in city)
    for name in ("cocostuff", "cityscapes"):
        with pytest.raises(ValueError):
            R.dataset(spark, name, str(tmp_path), "test")


def test_inventory_preview_and_video(spark, tmp_path):
    touch(tmp_path, "sa_1.jpg", "sa_1.json", "sa_2.jpg", "other.jpg")
    touch(tmp_path, "sa_2.json", data=b"")
    assert {r["stem"]: r["parts"] for r in C.inventory(C.files(spark, str(tmp_path))).collect()} == {"sa_1": ["jpg", "json"], "sa_2": ["jpg"]}
    assert [os.path.basename(r["path"]) for r in C.preview(C.files(spark, str(tmp_path)), 2).collect()] == ["other.jpg", "sa_1.jpg"]
    video = tmp_path / "v"
    touch(video, *[f"JPEGImages/480p/bear/{i:05d}.jpg" for i in range(3)], "Annotations_unsupervised/480p/bear/00000.png")
    touch(video, "ImageSets/2017/val.txt", data=b"bear \n")
    rows = C.video_catalogue(spark, str(video)).orderBy("frame").collect()
    assert [os.path.basename(r["image"]) for r in rows] == ["00000.jpg", "00001.jpg", "00002.jpg"] and [os.path.basename(r["mask"]) for r in rows] == ["00000.png", "-1", "-1"]
    touch(video, "ImageSets/2017/train.txt", data=b"wolf\n")
    with pytest.raises(Exception, match="wolf"):
        C.video_catalogue(spark, str(video), subset="train").collect()
    with pytest.raises(ValueError):
        C.video_catalogue(spark, str(video), task="none")


def test_manifest(spark, tmp_path):
    path = tmp_path / "links.txt"
    path.write_text("﻿cdn_link\tfile_name\r\nhttps://h/b\t b.tar \r\nhttps://h/a\ta.tar\nhttps://h/ids\tids.txt\nhttps://h/b2\tb.tar\n", encoding="utf-8")
    rows = C.read_manifest(spark, str(path)).orderBy("line").collect()
    assert [(r["file_name"], r["cdn_link"]) for r in rows] == [("b.tar", "https://h/b"), ("a.tar", "https://h/a")]
    for text in ("file_name\tlink\na.tar\thttps://x\n", "file_name\tcdn_link\n", "file_name\tcdn_link\na.txt\thttps://x\n", "file_name\tcdn_link\na.tar\tftp://x\n", ""):
        path.write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            C.read_manifest(spark, str(path)).collect()


def test_legacy_cursor(spark):
    keys = spark.createDataFrame([(f"sa_{i}",) for i in (10, 9, 100, 2)], "key string")
    assert sorted(r["key"] for r in C.legacy_skip(keys, 3).collect()) == ["sa_10", "sa_2", "sa_9"]
    with pytest.raises(ValueError):
        C.legacy_skip(keys, 5)
    pairs = spark.createDataFrame([("sa_2", 0, 1), ("sa_100", 0, 2), ("sa_5", 1, 1), ("sa_6", 1, 2)], "key string, source int, n int")
    assert sorted(r["key"] for r in C.resumed(pairs, 0, (0, 0), C.legacy_skip(keys, 1)).collect()) == ["sa_100", "sa_5", "sa_6"]
    assert sorted(r["key"] for r in C.resumed(pairs, 1, (1, 1)).collect()) == ["sa_6"]


def samples(spark, n):
    return spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit("sa_"), "id").alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("jpg"), F.encode(F.lit("{}"), "UTF-8").alias("json"))


def test_shard_writer_resumes(spark, tmp_path):
    folder = str(tmp_path / "out")
    state = K.write_shards(samples(spark, 25), folder, 10, {"q": 90}, ["one"])
    assert [(s["name"], s["samples"]) for s in state["shards"]] == [("shard-000000.tar", 10), ("shard-000001.tar", 10)]
    for s in state["shards"]:
        data = (tmp_path / "out" / s["name"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (s["bytes"], s["sha256"])
    before = os.stat(tmp_path / "out" / "shard-000000.tar").st_mtime_ns
    more = K.write_shards(samples(spark, 38), folder, 10, {"q": 90}, ["one", "two"])
    assert len(more["shards"]) == 3 and more["sources"] == ["one", "two"] and before == os.stat(tmp_path / "out" / "shard-000000.tar").st_mtime_ns
    assert len(K.write_shards(samples(spark, 38), folder, 10, {"q": 90}, ["one", "two"], keep_remainder=True)["shards"]) == 4
    assert sorted(os.listdir(folder)) == [*[K.shard_name(k) for k in range(4)], "state.json"]
    spark.dataSource.register(ShardSource)
    read = spark.read.format("tarshards").load(folder)
    assert sorted(int(bytes(r["jpg"])) for r in read.collect()) == list(range(38))
    some = spark.read.format("tarshards").option("paths", json.dumps([f"{folder}/shard-000001.tar"] * 2)).load()
    assert [r["key"] for r in some.collect()] == [f"sa_{i}" for i in range(10, 20)]
    for change in ({"configuration": {"q": 80}, "sources": ["one", "two"]}, {"configuration": {"q": 90}, "sources": ["two"]}):
        with pytest.raises(ValueError):
            K.write_shards(samples(spark, 38), folder, 10, **change)
    with pytest.raises(ValueError):
        K.write_shards(samples(spark, 3), folder, 0)
    assert stores.load_state(f"{folder}/state.json")["finished"] and not [f for f in os.listdir(folder) if f.endswith(".part")]


def test_resolve_and_open(tmp_path):
    touch(tmp_path, "a.tar", "b.tar.part", "c.pending", "d/e.tar")
    assert [os.path.basename(p) for p in resolve(str(tmp_path))] == ["a.tar"]
    assert resolve(["s3://bucket/b.tar", "s3://bucket/a.tar", "s3://bucket/a.tar"]) == ["s3://bucket/a.tar", "s3://bucket/b.tar"]
    assert resolve("https://h/x.tar?sig=1") == ["https://h/x.tar?sig=1"] and resolve(f"{tmp_path}/*.tar") == [f"{tmp_path}/a.tar"]
    for bad in (str(tmp_path / "b.tar.part"), [str(tmp_path / "c.pending")], [], str(tmp_path / "none"), f"{tmp_path}/*.zip"):
        with pytest.raises(ValueError):
            resolve(bad)
    touch(tmp_path, "d/f/g.tar")
    names = lambda pattern: [os.path.relpath(f.removeprefix("file://"), tmp_path) for f in stores.listed(pattern)]
    assert names(f"file://{tmp_path}/*.tar") == ["a.tar"] == names(f"{tmp_path}/[ab].tar") and names(f"{tmp_path}/*/*.tar") == ["d/e.tar"]
    assert names(f"file://{tmp_path}/**/*.tar") == ["a.tar", "d/e.tar", "d/f/g.tar"] and names(f"{tmp_path}/none/*.tar") == []
    with stores.opened(f"file://{tmp_path}/a.tar") as stream:
        assert stream.read() == b"x"
    for bad in ("ftp://h/a.tar", str(tmp_path / "none.tar")):
        with pytest.raises(Exception) as caught, stores.opened(bad):
            pass
        assert any("in the file" in n for n in caught.value.__notes__)


def test_broken_pairs_are_errors(spark, tmp_path):
    spark.dataSource.register(ShardSource)
    for k, names in enumerate((["a.jpg"], ["a.jpg", "b.jpg", "b.json"], ["a.jpg", "a.jpg"], ["a.jpg", "a.json", "a.jpg"])):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for n in names:
                t.addfile(tarfile.TarInfo(n), io.BytesIO())
        touch(tmp_path, f"{k}/x.tar", data=out.getvalue())
        with pytest.raises(Exception, match="incomplete|twice"):
            spark.read.format("tarshards").load(str(tmp_path / str(k))).collect()


def test_extract_files(spark, tmp_path):
    rows = samples(spark, 4)
    assert K.extract_files(rows, str(tmp_path)).where("saved").count() == 4
    (tmp_path / "sa_2.jpg").write_bytes(b"")
    assert [r["key"] for r in K.extract_files(rows, str(tmp_path)).where("saved").collect()] == ["sa_2"] and (tmp_path / "sa_2.jpg").read_bytes() == b"2"
    broken = rows.withColumn("json", F.when(F.col("ordinal") != 1, F.col("json"))).coalesce(1)
    with pytest.raises(Exception, match="incomplete samples"):
        K.extract_files(broken, str(tmp_path / "more")).collect()
    assert len(os.listdir(tmp_path / "more")) == 6


def test_places_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").when(F.col("id") < 4500, "b").alias("g"), F.col("id").alias("o"))
    got = L.places(rows, ["g"], F.floor(F.col("o") / 100), ["o"]).collect()
    assert all(r["place"] == (r["o"] if r["g"] == "hot" else r["o"] - 4000 if r["g"] == "b" else r["o"] - 4500) for r in got) and len(got) == 5000


@pytest.mark.parametrize(("shards", "world", "workers"), [(3, 1, 2), (2, 3, 2), (4, 2, 1)])
def test_cycling_stream(spark, shards, world, workers):
    rows = spark.range(60 * shards).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("place"), F.concat(F.lit("sa_"), "id").alias("key"), F.lit("{}").alias("json"))
    options = {"shards": shards, "world_size": world, "workers": workers, "train_batches": 50, "val_batches": 9, "val_fraction": 0.3, "batch_size": 2}
    train, val = R.make_loaders(rows, options)
    assert "json" in train.columns and "json" not in val.columns
    seen = {}
    for name, stream, size in (("train", train, 2), ("val", val, 1)):
        by = {}
        for r in stream.collect():
            by.setdefault(r["consumer"], []).append((r["position"], r["key"], r["pass"]))
        batches = options[f"{name}_batches"]
        assert {c: len(v) for c, v in by.items()} == {c: len(range(c % workers, batches, workers)) * size for c in range(world * workers)}
        for v in by.values():
            assert sorted(p for p, _, _ in v) == list(range(len(v)))
            first = [k for _, k, n in v if n == 0]
            assert len(first) == len(set(first))
        own = [{k for _, k, _ in v} for v in by.values()]
        assert sum(map(len, own)) == len(set().union(*own))
        seen[name] = set().union(*own)
    assert not seen["train"] & seen["val"]
    with pytest.raises(Exception, match="no val samples"):
        L.cycling_stream(rows.where("shard = 0"), shards + 1, "val", 8, 1, world=shards + 1).collect()
    for bad in ({"split": "test"}, {"split": "val", "batches": 0}, {"split": "val", "val_fraction": 0.0}):
        with pytest.raises(ValueError):
            L.cycling_stream(rows, shards, **({"batches": 1, "batch": 1} | bad))


def test_finite_stream(spark):
    rows = spark.range(80).select(F.floor(F.col("id") / 20).alias("shard"), (F.col("id") % 20).alias("place"), "id")
    got = L.finite_stream(rows, 20, 8, 48, 4, world=2, workers=5).orderBy("ordinal").collect()
    assert [r["id"] for r in got] == list(range(8, 56))
    for r in got:
        rank, batch = divmod((r["ordinal"] - 8) // 4, 6)
        worker = next(w for w in range(5) if 6 * w // 5 <= batch < 6 * (w + 1) // 5)
        assert (r["rank"], r["worker"]) == (rank, worker)
    for bad in ((20, 0, 10, 4, 2), (0, 0, 8, 4, 1), (20, -1, 8, 4, 1), (20, 0, 0, 4, 1)):
        with pytest.raises(ValueError):
            L.finite_stream(rows, *bad)
    assert [(r["shard"], r["n"]) for r in L.short_shards(rows.where("id < 65"), 20, 4).collect()] == [(3, 5)]


def test_registries():
    assert R.featurizer("DINOv3B") == ("dinov3base", 16, 768) and R.upsampler("bilinear") is G.resize_bilinear
    for f in (R.featurizer, R.upsampler):
        with pytest.raises(ValueError):
            f("none")
    got = R.composed([{"a": 1, "b": "x", "flag": False}], {"name": "${b}-${a}", "home": "${env:HOME_OF,none}/c", "same": "${a}"}, {"HOME_OF": "/h"}, ["a=3", "flag=true"])
    assert got == {"a": 3, "b": "x", "flag": True, "name": "x-3", "home": "/h/c", "same": 3}
    with pytest.raises(ValueError):
        R.composed([], {"a": 1}, {}, ["b=2"])


def test_run_id_has_its_form(spark):
    assert spark.range(1).select(F.rlike(R.run_id(), F.lit("^[0-9]{8}T[0-9]{6}Z-[0-9a-f]{8}$"))).first()[0]
    with pytest.raises(ValueError):
        R.make_loaders(spark.range(1), {})


def test_cached_results(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return [spark.createDataFrame([(0.12345, "a")], "j double, s string")]

    for _ in range(2):
        (out,) = T.cached_results([str(tmp_path / "g")], compute, spark)
        assert out.first()["j"] == 0.123
    assert len(calls) == 1


def plane(spark, x):
    return spark.createDataFrame([(0, r, c, float(v)) for (r, c), v in np.ndenumerate(x)], "image int, r int, c int, x double")


def test_jitter_and_bicubic(spark):
    x = np.random.default_rng(1).standard_normal((7, 9))
    padded = np.pad(x, ((2, 2), (3, 3)), mode="reflect")
    got = {(r["r"], r["c"]): r["x"] for r in G.jitter(plane(spark, x), 7, 9, 3, 2, 1.0, 1.0, 45.0).collect()}
    assert got == {(r, c): pytest.approx(v) for (r, c), v in np.ndenumerate(padded)}
    assert G.jitter(plane(spark, x), 7, 9, 0, 0, 1.3, 0.6).count() == int(7 * 1.3) * int(9 * 0.6)
    with pytest.raises(ValueError):
        G.reflect_pad(plane(spark, x), 7, 9, 7, 0)
    same = {(r["r"], r["c"]): r["x"] for r in G.resize_bicubic(plane(spark, x), 7, 9, 7, 9).collect()}
    assert same == {(r, c): pytest.approx(v) for (r, c), v in np.ndenumerate(x)}
    ones = G.resize_bicubic(plane(spark, np.ones((4, 5))), 4, 5, 11, 3).collect()
    assert len(ones) == 33 and all(r["x"] == pytest.approx(1) for r in ones)


@pytest.mark.parametrize(("h", "w", "k"), [(13, 16, 4), (8, 8, 8), (9, 7, 3)])
def test_attention_downsample(spark, h, w, k):
    rng = np.random.default_rng(2)
    x, linear, scale, bias = rng.standard_normal((h, w, 3)), rng.standard_normal(3), rng.standard_normal(k * k), rng.standard_normal(k * k)
    rows = spark.createDataFrame([(0, r, c, x[r, c].tolist()) for r in range(h) for c in range(w)], "image int, r int, c int, v array<double>")
    got = {(r["pr"], r["pc"], r["d"]): r["x"] for r in G.attention_downsample(rows, h, w, k, linear.tolist(), scale.tolist(), bias.tolist()).collect()}
    oh, ow = h // k, w // k
    sh, sw = ((n - k) // (o - 1) if o > 1 else k for n, o in ((h, oh), (w, ow)))
    assert len(got) == oh * ow * 3
    for p in range(oh):
        for q in range(ow):
            patch = x[p * sh : p * sh + k, q * sw : q * sw + k].reshape(-1, 3)
            weights = np.exp(patch @ linear * scale + bias)
            assert [got[p, q, d] for d in range(3)] == pytest.approx((weights @ patch / weights.sum()).tolist())
    with pytest.raises(ValueError):
        G.patch_places(3, 9, 4)


def test_statistics_wrap_like_bytes(spark):
    x = np.random.default_rng(3).random(300)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "s string, f int, v double")
    ids = (np.round(np.linspace(1, 300, 5) + 1e-10) - 1).astype(np.int64)
    for wrap in (False, True):
        at = ids % 256 if wrap else ids
        bins = [x[at[i] : at[i + 1] + 1] for i in (0, 3)]
        want = bins[0].mean() - bins[1].mean() if len(bins[1]) else None
        got = M.sequence_statistics(rows, ["s"], "f", "v", wrap).first()
        assert got["mean"] == pytest.approx(x.mean()) and got["recall"] == pytest.approx((x > 0.5).mean()) and (got["decay"] is None if want is None else got["decay"] == pytest.approx(want))


def test_boundary_radius_and_empty_sets(spark):
    assert (M.bound_radius(25, 20), M.bound_radius(480, 854), M.bound_radius(10, 10, 3)) == (1, 8, 3)
    rows = []
    for image, (t, p) in enumerate([(False, False), (True, False), (False, True)]):
        rows += [(image, r, c, t and r < 2, p and r < 2) for r in range(4) for c in range(4)]
    got = {r["image"]: (r["precision"], r["recall"], r["f"]) for r in M.boundary_f(spark.createDataFrame(rows, "image int, r int, c int, truth boolean, pred boolean"), 4, 4).collect()}
    assert got == {0: (1.0, 1.0, 1.0), 1: (1.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0)}
    with pytest.raises(Exception, match="above the number"):
        M.proposal_scores(spark.createDataFrame([(0, 0, 1, 9)], "g int, f int, t int, p int"), "g", "f", "t", "p", 1, 2).collect()


def test_principal_components(spark):
    x = np.random.default_rng(4).standard_normal((400, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 7
    mean, components, variances = V.principal_components(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert mean == pytest.approx(x.mean(axis=0)) and variances == pytest.approx((s**2 / len(x))[:3])
    assert np.abs((components * vt[:3]).sum(axis=1)) == pytest.approx(np.ones(3))
    groups = spark.createDataFrame([(i % 300, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>").repartition(3)
    cells = {r["g"]: r["cells"] for r in V.second_moments(groups, "v", "v", "g", held=20).collect()}
    assert all(cells[g] == pytest.approx((x[g::300].T @ x[g::300]).ravel().tolist()) for g in range(300))


def test_ema_in_blocks(spark):
    x = np.random.default_rng(5).random(1000)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "g string, i int, x double")
    for every, after in ((1, 0), (3, 10), (7, 0)):
        a = x[0]
        for i, v in enumerate(x):
            if i and i % every == 0:
                a = v if i <= after else a + (v - a) * 0.1
        got = V.ema(rows, "g", "i", "x", 0.9, every, after, block=64, bucket=F.floor(F.col("i") / 100)).first()["ema"]
        assert got == pytest.approx(a)


def test_word_bpe_merges(spark):
    """Ids against a plain loop that merges the pair of the lowest rank until none is left."""
    vocabulary = json.loads(default_vocabulary())["model"]
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(vocabulary["merges"])}

    def merged(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: ranks.get(p, 1 << 30))
            if best not in ranks:
                break
            out, i = [], 0
            while i < len(parts):
                both = tuple(parts[i : i + 2]) == best
                out.append(parts[i] + parts[i + 1] if both else parts[i])
                i += 2 if both else 1
            parts = out
        return [vocabulary["vocab"][p] for p in parts]

    words = ["hello", "internationalisation", "zzxqy", "a", "photograph", "unbelievable"]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "id int, text string")
    ids = encode_words(rows, "id", "text")
    got = {r["id"]: r["ids"] for r in ids.collect()}
    assert got == {1: [i for w in words for i in merged(w)], 2: [], 3: []}
    assert {r["id"]: r["text"] for r in decode_words(ids, "id").collect()} == {1: " ".join(words), 2: "", 3: ""}


REFERENCES = [
    "&lt;b&gt; &amp;amp; &eacute;&#8217;&#x1F600;&#X41;", "&copyright; &notit; &not; &unknown; &amp &ampersand", "&#0; &#128; &#x110000; &#xD800; &#1; &#99999999999999;", "a & b &; &# &#x; &&lt;", None, "", "&nbsp;&NotEqualTilde;",
]


def test_unescape_as_the_standard_library(spark):
    import html

    rows = spark.createDataFrame(list(enumerate(REFERENCES)), "i int, t string")
    got = {r["i"]: r["u"] for r in rows.select("i", X.unescape(F.col("t")).alias("u")).collect()}
    assert got == {i: None if t is None else html.unescape(t) for i, t in enumerate(REFERENCES)}
    assert rows.where("i = 6").select(X.normalise(F.col("t"))).first()[0] == html.unescape("&NotEqualTilde;").lower()


def test_shards_over_http(spark, tmp_path):
    """A web address is a shard of its own: fetched as a stream by the task that reads it."""
    import functools
    import http.server
    import threading

    K.write_shards(samples(spark, 6), str(tmp_path), 3)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        urls = [f"http://127.0.0.1:{server.server_port}/{K.shard_name(k)}" for k in (0, 1)]
        spark.dataSource.register(ShardSource)
        rows = spark.read.format("tarshards").option("paths", json.dumps(urls)).load().collect()
        assert sorted(r["key"] for r in rows) == [f"sa_{i}" for i in range(6)] and {r["url"] for r in rows} == set(urls)
        with pytest.raises(Exception, match="404"):
            spark.read.format("tarshards").load(urls[0].replace("000000", "000009")).collect()
    finally:
        server.shutdown()

"""Fixed-size tar shards with a committed state: a rerun writes only what is not committed yet."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gridloom.sources.stores import exists, load_state, move, remove, save_state, store, write_bytes

VERSION = 2
#: Settings that states of version 1 hold and later ones do not.
OLD_SETTINGS = ("target_mb", "calibration_samples")


def tar_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """An archive of the members in order; the same members give the same bytes."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


def shard_name(number: int) -> str:
    return f"shard-{number:06d}.tar"


def migrated(state: dict, per_shard: int) -> dict:
    """A state of version 1 as one of version 2: its source under way is read in the old order, all later ones stream."""
    configuration = {k: v for k, v in state["configuration"].items() if k not in (*OLD_SETTINGS, "sources", "samples_per_shard")}
    sources = state.get("sources", state["configuration"].get("sources", []))
    cursor = state.get("cursor", [0, 0])
    return state | {"version": 2, "configuration": configuration, "sources": sources, "samples_per_shard": state.get("samples_per_shard") or per_shard, "legacy_source": cursor[0]}


def checked_state(state: dict | None, configuration: dict, sources: list[str], per_shard: int) -> dict:
    """The state to go on from; another configuration, or a source list that does not begin with the old one, is an error."""
    new = {"version": VERSION, "configuration": configuration, "sources": sources, "samples_per_shard": per_shard, "shards": [], "finished": False}
    if state is None:
        return new
    if state["version"] == 1:
        state = migrated(state, per_shard)
    if (state["version"], state["configuration"], state["samples_per_shard"]) != (VERSION, configuration, per_shard):
        raise ValueError("the folder was written with another configuration")
    if sources[: len(state["sources"])] != state["sources"]:
        raise ValueError("the list of sources may only be extended")
    return state | {"sources": sources, "finished": False}


@dataclass
class Receipts(WriterCommitMessage):
    """What a task has written: for each shard its name, its file for now, samples, bytes and digest."""

    shards: list[dict] = field(default_factory=list)


class Digest:
    """A writable stream that passes bytes on and knows their number and SHA-256."""

    def __init__(self, out):
        self.out, self.size, self.hash = out, 0, hashlib.sha256()

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        self.hash.update(data)
        return len(data)


class ShardWriter(DataSourceArrowWriter):
    """Shards of consecutive ordinals from rows (shard, ordinal, key, jpg, json) that come sorted, whole shards in one task.

    A task streams each shard to a file of its own attempt, below the job's hidden folder. Only receipts reach the driver. The
    commit first writes down which files become which shards, then moves them, then replaces the state; a run that
    dies in between is ended by the next one. A job that fails leaves no shard under its name and takes its files away.
    """

    def __init__(self, options: dict):
        self.folder, self.per_shard, self.keep = options["path"], int(options["per_shard"]), options.get("keep_remainder", "false") == "true"
        self.state = json.loads(options["state"])
        self.job = f"{self.folder}/.job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Receipts:
        attempt, out = f"{self.job}/{uuid.uuid4().hex}", Receipts()
        number = archive = stream = sink = None

        def end() -> None:
            if archive is not None:
                archive.close()
                stream.close()
                out.shards[-1] |= {"bytes": sink.size, "sha256": sink.hash.hexdigest()}

        for batch in iterator:
            names = batch.schema.names
            for row in zip(*(batch.column(names.index(c)) for c in ("shard", "key", "jpg", "json")), strict=True):
                shard, key, jpg, text = (x.as_py() for x in row)
                if shard != number:
                    end()
                    number, place = shard, f"{attempt}/{shard_name(shard)}"
                    system, path = store(place)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(path)
                    sink = Digest(stream)
                    archive = tarfile.open(fileobj=sink, mode="w|")
                    out.shards.append({"number": shard, "name": shard_name(shard), "file": place, "samples": 0})
                for kind, data in (("jpg", jpg), ("json", text)):
                    info = tarfile.TarInfo(f"{key}.{kind}")
                    info.size = len(data or b"")
                    archive.addfile(info, io.BytesIO(data or b""))
                out.shards[-1]["samples"] += 1
        end()
        return out

    def commit(self, messages: list[Receipts | None]) -> None:
        found = sorted((s for m in messages if m is not None for s in m.shards), key=lambda s: s["number"])
        if any(s["samples"] > self.per_shard for s in found) or any(s["samples"] < self.per_shard for s in found[:-1]):
            self.abort(messages)
            raise ValueError("ordinals have gaps or repeat")
        whole = [s for s in found if self.keep or s["samples"] == self.per_shard]
        moves = [[s["file"], f"{self.folder}/{s['name']}"] for s in whole]
        new = [{k: s[k] for k in ("name", "samples", "bytes", "sha256")} for s in whole]
        kept = [s for s in self.state["shards"] if s["name"] not in {n["name"] for n in new}]
        state = self.state | {"shards": sorted(kept + new, key=lambda s: s["name"]), "finished": True}
        save_state(f"{self.folder}/commit.json", {"moves": moves, "state": state, "job": self.job})
        recover(self.folder)

    def abort(self, messages: list[Receipts | None]) -> None:
        remove(self.job)


def recover(folder: str) -> bool:
    """End a commit that was written down but not carried out; whether there was one. Doing it twice changes nothing."""
    plan = load_state(f"{folder}/commit.json")
    if plan is None:
        return False
    for file, name in plan["moves"]:
        if exists(file):
            move(file, name)
    save_state(f"{folder}/state.json", plan["state"])
    remove(plan["job"])
    remove(f"{folder}/commit.json")
    return True


class ShardSink(DataSource):
    """df.write.format("tarshardsink").mode("append").save(folder), as ``write_shards`` prepares it."""

    @classmethod
    def name(cls):
        return "tarshardsink"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options)


def write_shards(samples: DataFrame, folder: str, per_shard: int, configuration: dict | None = None, sources: list[str] | None = None, keep_remainder: bool = False) -> dict:
    """Write (ordinal, key, jpg, json) samples as tar shards of ``per_shard`` consecutive ordinals, and return the state.

    Ordinals count from 0 without gaps. A run first ends a commit that an earlier one left, then writes what is not committed yet. A
    last partial shard is written only with ``keep_remainder`` and is then written anew when it has grown; otherwise its
    samples stay pending for a later run. A state of version 1 is taken over as one of version 2.
    """
    if per_shard <= 0:
        raise ValueError("a shard has at least one sample")
    spark = samples.sparkSession
    recover(folder)
    old = load_state(f"{folder}/state.json")
    state = checked_state(old, configuration or {}, sources or [], per_shard)
    if old is not None and old["version"] != state["version"]:
        save_state(f"{folder}/state.json", state)
    done = sum(s["samples"] == per_shard for s in state["shards"])
    shard = F.floor(F.col("ordinal") / per_shard).cast("bigint")
    rows = samples.where(F.col("ordinal") >= done * per_shard).select(shard.alias("shard"), "ordinal", F.col("key").cast("string").alias("key"), F.col("jpg").cast("binary").alias("jpg"), F.col("json").cast("binary").alias("json"))
    spark.dataSource.register(ShardSink)
    sorted_ = rows.repartitionByRange("shard").sortWithinPartitions("ordinal")
    sorted_.write.format("tarshardsink").options(per_shard=per_shard, keep_remainder=str(keep_remainder).lower(), state=json.dumps(state)).mode("append").save(folder)
    return load_state(f"{folder}/state.json")


def extract_files(samples: DataFrame, folder: str) -> DataFrame:
    """Samples as flat files key.jpg and key.json; (key, saved): those already there whole are left as they are.

    A sample with a missing part is an error, after the others of its partition have been saved.
    """
    from gridloom.sources.stores import store

    def run(batches):
        from pyarrow import fs

        system, path = store(folder)
        broken = []
        for batch in batches:
            saved = []
            for key, jpg, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if jpg is None or text is None:
                    broken.append(key)
                    saved.append(False)
                    continue
                there = [f.type == fs.FileType.File and f.size == len(data) for f, data in zip(system.get_file_info([f"{path}/{key}.jpg", f"{path}/{key}.json"]), (jpg, text), strict=True)]
                for kind, data, exists in zip(("jpg", "json"), (jpg, text), there, strict=True):
                    if not exists:
                        write_bytes(f"{folder}/{key}.{kind}", data)
                saved.append(not all(there))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(saved, pa.bool_())], names=["key", "saved"])
        if broken:
            raise ValueError(f"incomplete samples: {broken[:5]}")

    rows = samples.select("key", F.col("jpg").cast("binary").alias("jpg"), F.col("json").cast("binary").alias("json"))
    return rows.mapInArrow(run, "key string, saved boolean")

"""Tar shards of (jpg, json) pairs as a Python data source: one partition a shard, complete pairs or an error."""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.stores import listed, opened


def resolve(source: str | Iterable[str]) -> list[str]:
    """Distinct sorted .tar locations of a list, folder, prefix, glob, web address or single file; none is an error.

    A folder's other files (.part and .pending among them) are left out; naming one is an error.
    """
    if isinstance(source, str):
        found = listed(source)
        if found != [source]:
            found = [f for f in found if urlparse(f).path.endswith(".tar")]
    else:
        found = [str(s) for s in source]
    out = sorted(set(found))
    if not out:
        raise ValueError(f"no .tar shards in {source}")
    if wrong := [f for f in out if not urlparse(f).path.endswith(".tar")]:
        raise ValueError(f"not a whole .tar shard: {wrong[0]}")
    return out


def pairs_of(url: str) -> Iterator[tuple[str, str, bytes, bytes]]:
    """(key, url, jpg, json) of adjacent members, read as a stream; an incomplete or repeated one is an error."""
    with opened(url) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
        held: dict[str, bytes] = {}
        stem = None
        for member in archive:
            name, dot, kind = member.name.rpartition(".")
            if not member.isfile() or not dot or kind not in ("jpg", "json"):
                continue
            if name != stem:
                if held:
                    raise ValueError(f"{url}: {stem} is incomplete")
                stem = name
            elif not held:
                raise ValueError(f"{url}: {stem} comes twice")
            if kind in held:
                raise ValueError(f"{url}: {member.name} comes twice")
            held[kind] = archive.extractfile(member).read()
            if len(held) == 2:
                yield stem, url, held["jpg"], held["json"]
                held = {}
        if held:
            raise ValueError(f"{url}: {stem} is incomplete")


class Shard(InputPartition):
    def __init__(self, url: str):
        self.url = url


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.source = json.loads(options["paths"]) if "paths" in options else options["path"]

    def partitions(self):
        return [Shard(url) for url in resolve(self.source)]

    def read(self, partition):
        return pairs_of(partition.url)


class ShardSource(DataSource):
    """spark.dataSource.register(ShardSource); spark.read.format("tarshards").load(path), or option("paths", JSON list).load()."""

    @classmethod
    def name(cls):
        return "tarshards"

    def schema(self):
        return "key string, url string, jpg binary, json binary"

    def reader(self, schema):
        return ShardReader(self.options)

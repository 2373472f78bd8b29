"""Tar shards as a streaming source that passes over them again and again up to a quota, and goes on where it stopped."""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gridloom.sources.shards import pairs_of
from gridloom.sources.stores import load_state, save_state


class Piece(InputPartition):
    """Samples begin to end of a shard in a pass; ``position`` is the first one's place in the stream."""

    def __init__(self, url: str, turn: int, begin: int, end: int, position: int):
        self.url, self.turn, self.begin, self.end, self.position = url, turn, begin, end, position


class ShardStreamReader(DataSourceStreamReader):
    """Offsets are (pass, shard, place); the quota is the last one.

    How far batches were planned is kept in the file ``progress``, which is written before a batch runs. A stream
    that starts again from its checkpoint plans its unfinished batch anew and then goes on, ``step`` samples a batch.
    """

    def __init__(self, options: dict):
        self.folder, self.progress = options["path"], options.get("progress")
        state = load_state(f"{self.folder}/state.json")
        self.sizes = {s["name"]: s["samples"] for s in (state or {"shards": []})["shards"] if s["samples"]}
        self.total = sum(self.sizes.values())
        if not self.total:
            raise ValueError(f"no committed samples in {self.folder}")
        self.quota, self.step = int(options.get("quota", self.total)), int(options.get("step", 10_000))
        if min(self.quota, self.step) < 1:
            raise ValueError("quota and step must be positive")
        if not self.progress:
            # Without a place to remember, the stream is one batch.
            self.step = self.quota
        self.seed = options.get("seed")
        self.orders: dict[int, tuple[list[str], list[int]]] = {}

    def order(self, turn: int) -> tuple[list[str], list[int]]:
        """The shards of a pass, and the place of each one's first sample in it; with a seed every pass has an order of its own."""
        if turn not in self.orders:
            names = sorted(self.sizes)
            if self.seed is not None:
                names.sort(key=lambda n: hashlib.sha256(f"{self.seed}:{turn}:{n}".encode()).hexdigest())
            self.orders = {turn: (names, [0, *itertools.accumulate(self.sizes[n] for n in names)])}
        return self.orders[turn]

    def offset(self, position: int) -> dict:
        turn, rest = divmod(position, self.total)
        shard = bisect.bisect_right(self.order(turn)[1], rest) - 1
        return {"pass": turn, "shard": shard, "place": rest - self.order(turn)[1][shard]}

    def position(self, offset: dict) -> int:
        return offset["pass"] * self.total + self.order(offset["pass"])[1][offset["shard"]] + offset["place"]

    def initialOffset(self) -> dict:
        return self.offset(0)

    def latestOffset(self) -> dict:
        planned = load_state(self.progress) if self.progress else None
        return self.offset(min(self.quota, (planned or {"position": 0})["position"] + self.step))

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        at, stop, out = self.position(start), self.position(end), []
        if self.progress:
            save_state(self.progress, {"position": stop})
        while at < stop:
            turn, rest = divmod(at, self.total)
            names, firsts = self.order(turn)
            shard = bisect.bisect_right(firsts, rest) - 1
            begin, many = rest - firsts[shard], min(firsts[shard + 1] - rest, stop - at)
            out.append(Piece(f"{self.folder}/{names[shard]}", turn, begin, begin + many, at))
            at += many
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        found = 0
        for found, sample in enumerate(itertools.islice(pairs_of(partition.url), partition.begin, partition.end), 1):
            yield (partition.turn, partition.position + found - 1, *sample)
        if found != partition.end - partition.begin:
            raise ValueError(f"{partition.url} holds fewer samples than were committed")

    def commit(self, end: dict) -> None:
        pass


class ShardStream(DataSource):
    """spark.dataSource.register(ShardStream); spark.readStream.format("tarshardstream").option("quota", n).load(folder).

    ``folder`` holds shards and the state that the shard writer keeps. Options: quota (samples in all, by default one pass), step (samples a
    batch), progress (a file of the stream's own, needed for more than one batch), seed (an order a pass).
    """

    @classmethod
    def name(cls):
        return "tarshardstream"

    def schema(self):
        return "pass int, position bigint, key string, url string, jpg binary, json binary"

    def streamReader(self, schema):
        return ShardStreamReader(self.options)

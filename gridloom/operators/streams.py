"""Bounded shuffles of a stream of records, and results as lines of text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def buffered_shuffle(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Each partition's rows in a random order made with a buffer of ``size`` rows; a permutation of the input.

    Memory is bounded by the buffer and one Arrow batch. A lost task repeats the same order if its input
    comes in the same order.
    """
    if size <= 0:
        raise ValueError("size must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            table = table.take(rng.permutation(table.num_rows))
            spare = max(0, table.num_rows - size)
            yield from table.slice(0, spare).to_batches()
            # take() copies, so what is held keeps no more than the last buffer and batch alive.
            held = table.slice(spare)
        if held is not None:
            yield from held.take(rng.permutation(held.num_rows)).to_batches()

    return rows.mapInArrow(run, rows.schema)


def reservoir_shuffle(rows: DataFrame, group: str, order: list[str], size: int, seed: int = 0) -> DataFrame:
    """Each group's stream of rows in shuffled order, with ``position``: once the buffer is full, every row takes the place of a random one, which is given up.

    At the end the rest comes in random order. Slots come from a hash of seed, group and place, so a task that runs again gives the
    same order. A group is one stream and passes through one task, which holds ``size`` rows and an Arrow batch.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = rows.columns.index(group)

    def slot(key, i: int) -> int:
        return int(hashlib.md5(f"{seed}:{key}:{i}".encode()).hexdigest()[:8], 16) % size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, held = None, 0, []
        # Rows are places in a pool of at most ``size`` held rows and the batch.
        pool = None

        def ended() -> list:
            """Places of the rest, in order."""
            return sorted(range(len(held)), key=lambda j: (hashlib.md5(f"{seed}:{key}:rest:{j}".encode()).hexdigest(), j))

        def given(table: pa.Table, places: list[int], positions: list[int]) -> list[pa.RecordBatch]:
            return table.take(pa.array(places, pa.int64())).append_column("position", pa.array(positions, pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            base = 0 if pool is None else pool.num_rows
            pool = table if pool is None else pa.concat_tables([pool, table])
            places, positions = [], []
            for k, own in enumerate(batch.column(at).to_pylist(), base):
                if seen and own != key:
                    places += [held[j] for j in ended()]
                    positions += range(seen - len(held), seen)
                    seen, held = 0, []
                key = own
                if seen < size:
                    held.append(k)
                else:
                    j = slot(key, seen)
                    places.append(held[j])
                    positions.append(seen - size)
                    held[j] = k
                seen += 1
            yield from given(pool, places, positions)
            # take() copies, so what is held keeps no batch alive.
            pool, held = pool.take(pa.array(held, pa.int64())), list(range(len(held)))
        if held:
            yield from given(pool, ended(), list(range(seen - len(held), seen)))

    sorted_ = rows.repartition(group).sortWithinPartitions(group, *order)
    return sorted_.mapInArrow(run, f"{columns}, position bigint")


def score_lines(scores: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """(keys, measure, line) for each further column: ``Name: value`` with fixed digits."""
    names = [c for c in scores.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])
    line = F.format_string(f"%s: %.{digits}f", "measure", "value")
    return scores.select(*keys, F.inline(pairs)).select(*keys, "measure", line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines as text files; the committer publishes all of a job's files or none."""
    lines.select("line").write.mode("errorifexists").text(path)


def cached_results(paths: list[str], compute, spark) -> list[DataFrame]:
    """The result tables at the paths if all are there, else those that ``compute()`` gives, written there and read back."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    read = lambda p: spark.read.option("header", True).option("inferSchema", True).csv(p)
    try:
        return [read(p) for p in paths]
    except (AnalysisException, Py4JJavaError):
        for p, table in zip(paths, compute(), strict=True):
            write_result_table(table, p, mode="overwrite")
        return [read(p) for p in paths]


def write_result_table(scores: DataFrame, path: str, digits: int = 3, mode: str = "errorifexists") -> None:
    """Scores as CSV with a header; doubles are rounded."""
    rounded = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes]
    scores.select(*rounded).write.mode(mode).option("header", True).csv(path)

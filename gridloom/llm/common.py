"""What the operators share: words, checkpoints, ids and Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the separators between words, as a regular expression.
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """Number of words as a long; null gives 0."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    # Only the first and the last part can be empty.
    first = (F.get(parts, F.lit(0)) == "").cast("int")
    last = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - first - last).cast("long")


def lower_az(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    A local session may name none and gets a temporary one; on a cluster that is an error, as executors would not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files behind checkpoints that are written by now.

    It deletes them once the driver has collected their objects, which by itself may take half an hour, while
    executors' disks fill. Python's gateway passes on what it has let go within a second, so this takes a little more; it is
    skipped within SHORT seconds of the last time, when little can have been written.
    """
    global _released
    if time.monotonic() - _released < SHORT:
        return
    gc.collect()
    time.sleep(1.2)
    # The first collection frees what holds the shuffles, the second the shuffles.
    spark._jvm.System.gc()
    time.sleep(0.3)
    spark._jvm.System.gc()
    _released = time.monotonic()


SHORT, _released = 5.0, time.monotonic()
#: Tables that ``stored`` wrote inside the innermost ``temporary_tables``.
_written: list[list[str]] = []


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as a Parquet table in the shared folder and read again: compressed, and read by column.

    The table stays, as a checkpoint does, unless it is written inside ``temporary_tables``.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that the session can write to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are deleted at the end; results that read them must be written by then."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            remove(spark, path)


def repeated(df: DataFrame, copies: str, number: str | None = None) -> DataFrame:
    """Each row as often as its column ``copies`` says; ``number`` names a column that counts them from 0.

    Two steps, so that the arrays behind it stay short for rows with very many copies.
    """
    step, most = f"_{uuid.uuid4().hex}", F.lit(1 << 16)
    from_, upto = F.col(step) * most, F.least((F.col(step) + 1) * most, F.col(copies)) - 1
    df = df.withColumn(step, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / most).cast("bigint"))))
    return df.withColumn(number or step, F.explode(F.sequence(from_, upto))).drop(step)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[df["`" + c.replace("`", "``") + "`"] for c in df.columns])


def type_of(df: DataFrame, name: str) -> str:
    """A column's type as DDL."""
    return df.schema[name].dataType.simpleString()


def batches_of(batches: Iterator[pa.RecordBatch], most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``most`` bytes of its text column.

    A single longer text stays whole in a piece of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

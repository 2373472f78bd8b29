"""Session settings used by tests, the bench and local runs; a cluster brings its own."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one in a local session only, since executors must share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))
    return context.getCheckpointDir()


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution, UTC and no UI."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


#: Folders made for intermediate tables and files, removed when the driver's Python ends.
_made: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that executors share, as a plain path where it is local; it ends with the driver."""
    if not _made:
        atexit.register(_clean)
    _made.append(f"{work_folder(spark).removeprefix('file:')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _clean() -> None:
    from gridloom.sources.stores import remove

    while _made:
        with suppress(OSError, ValueError):
            remove(_made.pop())


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as a Parquet table below the folder that executors share, and read again: what follows starts from there."""
    path = fresh_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)

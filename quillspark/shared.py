"""The folder that driver and executors share, and small whole-file steps in it."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which only local sessions, such as tests, may leave unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Batches to and from Python are bounded by their bytes, as texts may be of any length; a setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "4m")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most `rows` rows and about `size` bytes: bounds what Python holds at once."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * size / max(1, b.nbytes)))) if b.num_rows else 1
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def clear(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver's memory is cleared."""
    gc.collect()
    spark._jvm.System.gc()


def store_of(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = store_of(spark, path)
    fs.delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    fs, p = store_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_small(spark: SparkSession, path: str) -> str:
    fs, p = store_of(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A small file, whole or not at all: written under another name, then renamed. False if there is one of that name."""
    fs, p = store_of(spark, path)
    if fs.exists(p):
        return False
    _, aside = store_of(spark, f"{path}.{spark._jvm.java.util.UUID.randomUUID().toString()}.tmp")
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = fs.rename(aside, p)
    if not done:
        fs.delete(aside, False)
    return done

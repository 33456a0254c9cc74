"""Helpers that all operators here share: the shared folder, written tables, word hashing."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import clear, delete, shared_dir, slices, small_batches  # noqa: F401  the operators take clear and slices from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as F.col() and DDL take it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def save(df: DataFrame, tag: str, sweep: bool = False) -> DataFrame:
    """df as a written table in the shared folder: cuts the lineage, so a lost executor costs a re-read only. sweep: clear()
    what only this table needed."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    if sweep:
        clear(spark)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of save() that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._saved_at)


def finish(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """A small result as a table of its own, when the larger tables that it was made from are deleted."""
    out = save(result, "result")
    forget(*tables)
    return out


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2: such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def hash_order(doc_id: Column) -> Column:
    """A fixed pseudo-random order for bounded samples."""
    return F.xxhash64(doc_id, F.lit(20240))


def sample_of_each(rows: DataFrame, by: str, most: int, *ties: str) -> DataFrame:
    """At most `most` rows for each value of `by`, the first by h (of hash_order()). About twice as many lie under a share that the count
    of each value gives; only those are sorted, however many rows there are. by: a column of few values."""
    counts = rows.groupBy(by).agg(F.count("*").alias("_count"))
    few = rows.join(F.broadcast(counts), by).filter((F.col("h") / 2.0**64 + 0.5) * F.col("_count") < 2 * most + 100)
    return few.withColumn(
        "_place", F.row_number().over(Window.partitionBy(by).orderBy("h", *ties))
    ).filter(F.col("_place") <= most).drop("_count", "_place")


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def as_texts(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash. Emptied when it holds `most` words, so that memory is bounded."""

    most = 250_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]):
    """What a Python worker keeps between tasks: one thing at a time, as a worker that serves one operator after another must not
    hold the memory of all of them."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def word_hashes() -> WordHashes:
    return kept("words", WordHashes)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * _M1
    h = h ^ (h >> np.uint64(29))
    h = h * _M2
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values (all of them as one, if fewer)."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * _M1
            out = out ^ (out >> np.uint64(32))
        return mix(out)


def crc_append(crc_a: int, crc_b: int, n_b: int) -> int:
    """crc32 of a + b, from the two checksums and the length of b."""
    zeros = bytes(n_b)
    return crc_b ^ zlib.crc32(zeros, crc_a) ^ zlib.crc32(zeros)


def crc_parts(parts: list[tuple[int, int]]) -> int:
    """crc32 of parts joined, from (checksum, length) of each."""
    out = 0
    for k, (c, n) in enumerate(parts):
        out = crc_append(out, c, n) if k else c
    return out

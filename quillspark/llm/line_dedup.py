"""Line dedup with two Bloom filters, for once-seen and twice-seen lines.

A line's key is the line without white space at both ends, A-Z in lower case; only keys of at least `size` code points count.
1. Every task hashes its keys, once a row, and sends them packed by segment of the filters: those it met once, and those
   it met several times.
2. Each segment has two Bloom filters. A hash that the first one knows, or that a task met several times, goes to the second one, the rest
   to the first. Only the second filter is needed later: a key of two rows or more is always in it.
3. The texts are read again. Keys that the second filter knows are suspects; all others are unique for certain, and nothing of them is
   ever shuffled. Suspects go on as 128-bit hashes with their row's id, and are counted exactly: keys of at least `rows` rows are
   repeats, and the largest id that holds one keeps it.
4. What each text loses is joined to it, and its lines are cut.

The filters have SEGMENTS segments of a size that follows the number of hashes, up to MOST_BITS in all (64 MB, the only thing that is
broadcast). Past that size they know more keys that aren't repeated: suspects, and what is shuffled (24 bytes a
key, never a text), grow up to all keys, but the result is the same.

Defined results: a null or empty text is one empty line; texts of any length are read whole; each row is a document of its own, also rows of one
id, and a key counts once a row; a repeat stays in all rows of its largest id; rows with a null id count, and keep a repeat only if
all its rows have a null id; an empty table gives an empty table; other columns are ignored, whatever their names. Keys are compared by
128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, forget, mix, save, slices, spread

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
SEGMENTS, MOST_BITS, BITS_A_KEY, PROBES = 64, 1 << 29, 16, 3
#: Hashes, or suspects, that a task holds before it sends them.
HELD = 500_000
#: Parts of the texts' ids, by which the rows of one repeat are dealt out.
SALT = 16


def keys_of(text: bytes, size: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose keys have at least `size` code points."""
    out = []
    for k, line in enumerate(text.split(b"\n")):
        if len(line) >= size:
            key = line.strip(BLANK).lower()  # of bytes: A-Z only
            if len(key) >= size and (key.isascii() or len(key.decode()) >= size):
                out.append((k, key))
    return out


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def segment_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(58)).astype(np.int64)  # the upper bits of 64: SEGMENTS values


class Bloom:
    """Bits of one segment; a hash's PROBES places come from two mixes of it."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = np.uint64(bits)
        self.words = np.frombuffer(data, np.uint8) if data else np.zeros(bits >> 3, np.uint8)

    def places(self, h: np.ndarray) -> np.ndarray:
        a, b = mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        with np.errstate(over="ignore"):
            return (a[None] + np.arange(PROBES, dtype=np.uint64)[:, None] * b[None]) % self.bits

    def add(self, h: np.ndarray) -> None:
        p = self.places(h).ravel()
        np.bitwise_or.at(self.words, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, p & np.uint64(7)).astype(np.uint8))

    def knows(self, h: np.ndarray) -> np.ndarray:
        p = self.places(h)
        return (self.words[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).all(0)


def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(segment, n, once, twice): the hashes of a task by segment."""
    h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    cuts = np.searchsorted(segment_of(h), np.arange(SEGMENTS + 1))
    rows = []
    for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if z > a:
            rows.append((s, int(z - a), h[a:z][n[a:z] == 1].tobytes(), h[a:z][n[a:z] > 1].tobytes()))
    if rows:
        s, size, once, twice = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(s, pa.int32()), pa.array(size, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
            names=["segment", "n", "once", "twice"]
        )


def twice_seen(texts: DataFrame, size: int) -> tuple[Broadcast, int]:
    """The second filter's segments by number, and the bits of one."""
    spark = texts.sparkSession

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in slices(batches):
            for text in as_bytes(b.column(0)):
                own = np.unique(hashes([k for _, k in keys_of(text, size)]))
                held.append(own)
                n += len(own)
            if n >= HELD:
                yield from packed(held)
                held, n = [], 0
        yield from packed(held)

    seen = save(texts.mapInArrow(meet, "segment int, n long, once binary, twice binary"), "lines")
    n = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, 1 << max(20, (n * BITS_A_KEY).bit_length())) // SEGMENTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[Bloom, Bloom]] = {}
        for b in batches:
            for s, one, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s not in filters:
                    filters[s] = Bloom(bits), Bloom(bits)
                first, second = filters[s]
                for part, repeated in ((one, False), (more, True)):
                    h = np.frombuffer(part, np.uint64)
                    second.add(h if repeated else h[first.knows(h)])
                    first.add(h)
        for s, (_, second) in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([second.words.tobytes()], pa.binary())], names=["segment", "bits"])

    dealt = seen.select("segment", "once", "twice").repartition(min(SEGMENTS, spread(spark)), "segment")
    found = {r["segment"]: bytes(r["bits"]) for r in dealt.mapInArrow(fill, "segment int, bits binary").collect()}  # MOST_BITS at most
    forget(seen)
    return spark.sparkContext.broadcast(found), bits


def suspects(texts: DataFrame, size: int, known: Broadcast, bits: int) -> DataFrame:
    """(high, low, who, id): keys of a row that the second filter knows, as 128-bit hashes. texts: text, who, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: Bloom(bits, data) for s, data in known.value.items()}
        for b in slices(batches):
            keys = [list({k for _, k in keys_of(text, size)}) for text in as_bytes(b.column(0))]
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            flat = [k for ks in keys for k in ks]
            h = hashes(flat)
            s, hit = segment_of(h), np.zeros(len(h), bool)
            for one in np.unique(s).tolist():
                own = np.flatnonzero(s == one)
                hit[own] = filters[one].knows(h[own])
            at = np.flatnonzero(hit)
            wide = b"".join(xxhash.xxh3_128_digest(flat[k]) for k in at.tolist())
            both = np.frombuffer(wide, ">i8").reshape(-1, 2).astype(np.int64)
            rows = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), b.column(1).take(rows), b.column(2).take(rows)],
                names=["high", "low", "who", "id"]
            )

    return texts.mapInArrow(run, "high long, low long, who long, id long")


def dedup(docs: DataFrame, id_col: str, text_col: str, size: int = 40, rows: int = 5) -> DataFrame:
    """For each row: its id, n_lines, n_dropped and kept (the lines that stay, joined)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    src = src.withColumn("who", F.xxhash64("id", "text"))
    texts = src.select("text", "who", "id")
    known, bits = twice_seen(texts.select("text"), size)
    met = save(suspects(texts, size, known, bits), "suspects")
    known.unpersist()
    repeats = save(met.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter(F.col("n") >= rows), "repeats")
    # Rows of a repeat are dealt to SALT parts, as one line may be in a third of all texts.
    salted = met.withColumn("salt", F.pmod("who", F.lit(SALT)))
    all_salts = repeats.select("high", "low", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    lost = salted.join(all_salts, ["high", "low", "salt"]).filter(~F.col("id").eqNullSafe(F.col("last")))
    lost = save(lost.groupBy("who").agg(F.collect_set(F.struct("high", "low")).alias("lost")), "lost")  # a text's own lines
    forget(met, repeats)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lines, gone, kept = [], [], []
            for text, keys in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                own = text.split(b"\n")
                drop: set[int] = set()
                if keys:
                    known = {(x["high"], x["low"]) for x in keys}
                    for k, key in keys_of(text, size):
                        pair = np.frombuffer(xxhash.xxh3_128_digest(key), ">i8").tolist()
                        if tuple(pair) in known:
                            drop.add(k)
                lines.append(len(own))
                gone.append(len(drop))
                kept.append(b"\n".join(x for k, x in enumerate(own) if k not in drop) if drop else text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "n_lines", "n_dropped", "kept"]
            )

    whole = src.join(lost, "who", "left").select("id", "text", "lost")
    out = whole.mapInArrow(cut, "id long, n_lines long, n_dropped long, kept string")
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "kept")

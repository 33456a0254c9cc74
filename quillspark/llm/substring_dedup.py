"""Substring dedup: words covered by a window of `window` words that also starts earlier are removed.

Fixed-block anchors. Every document is cut into non-overlapping blocks of half a window; those are the index. Every
rolling window of that length probes it. Two equal windows of full length each hold a whole block of their own document,
which the other one's rolling windows meet; so a repeat shows in the blocks that were met. Around these (and nowhere
else) the hits are extended: all full windows over met blocks only are hashed, the earliest start of each hash stays and
the others' words go. Runs of such windows are the maximal exact repeats. Full windows are told apart by a hash of up to 63 bits and
another one of 32.

Hashes travel packed: one row for each task and hash bucket, bytes of the values in planes, places as gaps, with the ids of
the documents that they are in. What a task has several times it settles before the shuffle (all but the earliest start are known
to repeat) and sends once, so a passage that all documents share comes once from each task. What a reducing task holds is one bucket.

Defined results: null and empty texts have no words; rows with a null id take no part and lose nothing; rows with one id
count as one place in the order, so that none of them is earlier than its equal (windows of such rows that start at different words are
ordered by these: the row where it starts later loses it); texts of any length are read whole; an empty table gives
an empty table; other columns are ignored, whatever their names, as are those that are handed through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, clear, forget, grams, mix, quoted, save, slices, spread, word_hashes

SPACE = r"[\x20\x09-\x0D]+"
#: Hashes that a task gathers before it sends them.
GATHER = 4_000_000

def planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of unsigned values, byte by byte."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(n, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :n] = x.T
    return out.view("<u8").reshape(-1)


def gaps(x: np.ndarray, n: int) -> bytes:
    """Signed values by their differences."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return planes(((d << 1) ^ (d >> 63)).view(np.uint64), n)


def ungaps(data: bytes, n: int) -> np.ndarray:
    z = unplanes(data, n)
    return np.cumsum((z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64))


class Gatherer:
    """Packs (hash, check, place in a document) by hash bucket. settle() takes hash, check, place, document and the ids of the documents, and
    returns which are to be sent, with what places, and what is known without (two arrays, sent as they are)."""

    names = ("bucket", "hash", "check", "place", "ids", "rows", "starts")
    schema = "bucket int, hash binary, check binary, place binary, ids binary, rows binary, starts binary"

    def __init__(self, buckets: int, width: int, settle: Callable, turn: int = 0):
        self.buckets, self.width, self.settle, self.turn = np.uint64(buckets), width, settle, turn
        self.clear()

    def clear(self) -> None:
        self.hash, self.check, self.place, self.ids, self.rows, self.starts, self.at, self.size = [], [], [], [], [], [], 0, 0

    def add(self, doc_id: int, row: int, h: np.ndarray, check: np.ndarray, place: np.ndarray, words: int) -> None:
        self.ids.append(doc_id)
        self.rows.append(row)
        self.starts.append(self.at)
        self.hash.append(h)
        self.check.append(check)
        self.place.append(place + self.at)
        self.at += words
        self.size += len(h)

    def flush(self) -> pa.RecordBatch:
        h, check, place = np.concatenate(self.hash), np.concatenate(self.check), np.concatenate(self.place)
        ids, rows, starts = np.array(self.ids, np.int64), np.array(self.rows, np.int64), np.array(self.starts, np.int64)
        doc = np.searchsorted(starts, place, "right") - 1
        send, place, known = self.settle(h, check, place, doc, ids, rows, starts)
        h, check, place, doc = h[send], check[send], place[send], doc[send]
        bucket = (h % self.buckets).astype(np.uint32)
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 65536 else bucket, kind="stable")
        h, check, place, doc, bucket = h[order] // self.buckets, check[order], place[order], doc[order], bucket[order]
        own, first = np.unique(bucket, return_index=True)
        ends = [*first[1:].tolist(), len(h)]
        out: list[list] = [[] for _ in range(6)]
        for a, z in zip(first.tolist(), ends, strict=False):
            d = np.unique(doc[a:z])
            for k, x in enumerate(
                (planes(h[a:z], self.width), planes(check[a:z], 4), gaps(place[a:z], 5), gaps(ids[d], 8), gaps(rows[d], 8), gaps(starts[d], 5))
            ):
                out[k].append(x)
        if len(known[0]):
            own = np.append(own, self.turn % int(self.buckets))
            for k, x in enumerate((None, None, None, gaps(known[0], 8), None, gaps(known[1], 8))):
                out[k].append(x)
        self.turn += 1
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(x, pa.binary()) for x in out)], names=list(self.names))


def repeated(h: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.sort(h)
    many = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(many):
        return np.zeros(len(h), bool)
    return many[np.minimum(np.searchsorted(many, h), len(many) - 1)] == h


def bucketwise(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, check, id, row, place) of each bucket, and the two arrays of what was known before. Batches come with the rows of a bucket
    together."""
    at, held = None, []
    for b in slices(batches):
        for k, h, c, p, i, r, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if h is None:
                yield ungaps(i, 8), ungaps(s, 8)
                continue
            if k != at and held:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            at = k
            place, starts = ungaps(p, 5), ungaps(s, 5)
            doc = np.searchsorted(starts, place, "right") - 1
            held.append((unplanes(h, width), unplanes(c, 4), ungaps(i, 8)[doc], ungaps(r, 8)[doc], place - starts[doc]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def by_bucket(packed: DataFrame) -> DataFrame:
    return packed.repartition(spread(packed.sparkSession), "bucket").sortWithinPartitions("bucket")


def met_blocks(docs: DataFrame, window: int) -> DataFrame:
    """(id, block): the blocks whose words a rolling window elsewhere (or at another place of the same document) equals."""
    half, buckets, width = window // 2, 4 * spread(docs.sparkSession), 4

    def settle(h, check, place, doc, ids, rows, starts):
        """Blocks that the task's own windows meet are known; of their hashes one goes on, as no block."""
        many = repeated(h)
        at = place - starts[doc]
        block = many & (at % half == 0)
        known = ids[doc[block]], at[block] // half
        send = ~many
        some = np.flatnonzero(many)
        send[some[np.unique(h[some], return_index=True)[1]]] = True
        return send, place + block, known

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gatherer(buckets, width, settle, task_number())
        mask = np.uint64(buckets << (8 * width))
        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = t.split()
                if i is not None and len(words) >= window:
                    h = grams(word_hashes().of(words), half) % mask
                    g.add(i, 0, h, np.zeros(len(h), np.uint8), np.arange(len(h)), len(words))
            if g.size > GATHER:
                yield g.flush()
        if g.size:
            yield g.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in bucketwise(batches, width):
            if len(x) == 2:
                ids, block = x
            else:
                h, _, ids, _, place = x
                hit = repeated(h) & (place % half == 0)
                ids, block = ids[hit], place[hit] // half
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(block.astype(np.int32))], names=["id", "block"])

    return by_bucket(docs.mapInArrow(probe, Gatherer.schema)).mapInArrow(meet, "id long, block int")


def later_windows(flagged: DataFrame, window: int, buckets: int) -> DataFrame:
    """(part, rows, places): starts of full windows whose words also start earlier, packed by part of the row."""
    half, spark, width = window // 2, flagged.sparkSession, 7
    own = 4 * spread(spark)

    def late(h, check, ids, place):
        """Which windows start later than an equal one, in order of `order`."""
        order = np.lexsort((place, ids, check, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else order
        out = np.zeros(len(h), bool)
        out[order] = (ids[order] != ids[lead]) | (place[order] != place[lead])
        return out

    def settle(h, check, place, doc, ids, rows, starts):
        """Windows that start earlier in the task itself are known; the earliest goes on."""
        some = np.flatnonzero(repeated(h))
        own_doc = doc[some]
        at = place[some] - starts[own_doc]
        gone = late(h[some], check[some], ids[own_doc], at)
        send = np.ones(len(h), bool)
        send[some[gone]] = False
        return send, place, (rows[own_doc[gone]], at[gone])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gatherer(own, width, settle, task_number())
        mask = np.uint64(min(own << 8 * width, (1 << 63) // own * own))
        for b in slices(batches):
            for row, i, t, blocks in zip(
                b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True
            ):
                words = t.split()
                n = len(words) - window + 1
                if n <= 0:
                    continue
                met = np.zeros(len(words) // half + 2, bool)
                blocks = np.array(blocks)
                met[blocks[blocks < len(met)]] = True
                s = np.arange(n)
                s = s[met[(s + half - 1) // half] & met[(s + half) // half]]  # the whole blocks that a window holds
                if len(s):
                    h10 = grams(word_hashes().of(words), half)
                    with np.errstate(over="ignore"):
                        h = mix(h10[s] * np.uint64(0x9E3779B97F4A7C15) ^ h10[s + half])
                        check = mix(h10[s + half] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h10[s]) >> np.uint64(32)
                    g.add(i, row, h % mask, check, s, len(words))
            if g.size > GATHER:
                yield g.flush()
        if g.size:
            yield g.flush()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def pack() -> pa.RecordBatch:
            """What several buckets have found, one row for each part."""
            rows, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            part = (mix(rows.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((place, rows, part))
            rows, place, part = rows[order], place[order], part[order]
            parts, begin = np.unique(part, return_index=True)
            ends = [*begin[1:].tolist(), len(part)][: len(begin)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(parts), pa.array([gaps(rows[a:z], 8) for a, z in zip(begin, ends, strict=True)], pa.binary()),
                    pa.array([gaps(place[a:z], 5) for a, z in zip(begin, ends, strict=True)], pa.binary())
                ],
                names=["part", "rows", "places"]
            )

        for x in bucketwise(batches, width):
            if len(x) == 2:
                held.append(x)
            else:
                h, check, ids, rows, place = x
                gone = late(h, check, ids, place)
                held.append((rows[gone], place[gone]))
            if sum(len(x) for x, _ in held) > GATHER // 4:
                yield pack()
        if held:
            yield pack()

    src = flagged.select("row", "id", "text", "blocks")
    return by_bucket(src.mapInArrow(extend, Gatherer.schema)).mapInArrow(first, "part int, rows binary, places binary")


def dedup(
    docs: DataFrame, id_col: str, text_col: str, window: int = 20,
    output: Callable[[Column], Column] = lambda kept: kept, as_is: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """For each row: its id, n_words, n_removed and kept: the words that stay, joined by one space (or what `output`
    makes of that text). as_is: a text that loses nothing stays as it was. carry: other columns to hand through."""
    assert window % 2 == 0
    spark = docs.sparkSession
    clear(spark)
    whole = F.struct(*(F.col(quoted(c)) for c in carry)) if carry else F.lit(None).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), whole.alias("carry"))
    met = met_blocks(src.select("id", "text"), window).groupBy("id").agg(F.collect_set("block").alias("blocks"))
    blocks = save(met, "blocks", sweep=True)
    joined = src.join(blocks.hint("merge"), "id", "left")  # the same plan at every size
    plain = F.regexp_replace(F.regexp_replace("text", SPACE, " "), "^ | $", "")
    hit = F.col("blocks").isNotNull()
    table = joined.select(
        F.monotonically_increasing_id().alias("row"), "id", "carry", "blocks", F.when(hit, F.col("text")).alias("text"),
        F.when(~hit, F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)).cast("long").alias("n_words"), F.when(
            ~hit, output(F.col("text") if as_is else plain)
        ).alias("kept"),
    )
    table = save(table, "repeats", sweep=True)
    forget(blocks)
    parts = spread(spark)
    flagged = table.filter(hit)
    gone = later_windows(flagged, window, parts)
    kind = table.schema["carry"].dataType
    row = T.StructType.fromDDL("part int, row long, id long").add("carry", kind).add("text", "string")
    # Windows to remove come before the texts of their part.
    texts = flagged.mapInArrow(with_part(parts), row).withColumn("late", F.lit(1))
    both = gone.withColumn("late", F.lit(0)).unionByName(
        texts, allowMissingColumns=True
    ).repartition(spread(spark), "part").sortWithinPartitions("part", "late")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, starts = None, {}
        for b in slices(batches):
            n_words, n_removed, kept, here = [], [], [], []
            for k, (p, late, r, s, row, text) in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True)):
                if p != at:
                    at, starts = p, {}
                if not late:
                    rows, place = ungaps(r, 8), ungaps(s, 5)
                    new = np.flatnonzero(np.diff(rows, prepend=rows[:1] - 1))
                    for x, own in zip(rows[new].tolist(), np.split(place, new[1:]), strict=True):
                        starts.setdefault(x, []).append(own)
                    continue
                words = text.encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                for own in starts.get(row, ()):
                    np.add.at(cover, own, 1)
                    np.add.at(cover, own + window, -1)
                stay = np.cumsum(cover[:-1]) == 0
                here.append(k)
                n_words.append(len(words))
                n_removed.append(len(words) - int(stay.sum()))
                kept.append(text if as_is and stay.all() else b" ".join([w for w, ok in zip(words, stay.tolist(), strict=True) if ok]).decode())
            at_rows = pa.array(here, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(6).take(at_rows), b.column(7).take(at_rows), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string())
                ],
                names=["id", "carry", "n_words", "n_removed", "kept"]
            )

    after = both.select("part", "late", "rows", "places", "row", "text", "id", "carry").mapInArrow(
        cut, T.StructType().add("id", "long").add("carry", kind).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    )
    after = after.withColumn("kept", output(F.col("kept")))
    rest = table.filter(~hit).select("id", "carry", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return rest.unionByName(after).select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *(F.col("carry").getField(c).alias(c) for c in carry))


def with_part(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("row").to_numpy(zero_copy_only=False).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((mix(rows) % np.uint64(parts)).astype(np.int32)), b.column("row"), b.column("id"), b.column("carry"), b.column("text")],
                names=["part", "row", "id", "carry", "text"]
            )

    return run

"""Packing documents into token sequences of a fixed window.

Whole windows are cut off each document first; what is left of it (its rest, under a window) is placed. The counts of
rests by length (a histogram of at most window - 1 bins) are matched by non-negative least squares with repeat
counts of shallow combinations, that is up to three lengths, one of them up to eight times, that fill a window exactly. Rounded down to what the
bins hold, they take most rests uncut; the others are packed greedily in lanes, cut where a window ends. There a cut
falls on a multiple of GRID tokens, whose checksums the first pass kept, so that no text is read twice.

Defined results: null and empty texts have the end id alone; repeated rows are packed as often as they occur; an
empty table gives an empty table; other columns are ignored. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import crc_parts, finish, kept, save, slices, spread

#: Chunks kept with their ids, by each Python worker.
KEPT = 400_000
#: Cuts fall on multiples of so many tokens within a rest.
GRID = 32
#: Rests that one task packs greedily.
LANE = 20_000


#: Letters that have one code point under NFC and one small form, then ASCII marks.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)").fullmatch


class Chunks:
    """Ids of white-space-free chunks. The vocabulary drops white space, and neither its normaliser nor its special
    tokens look across a space, so a text's ids are those of its chunks."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.core: dict[str, bytes] = {"": b""}
        ends = [i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]
        self.end = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.end[ends] = True

    def learn(self, cores: list[str], others: list[str]) -> None:
        """Ids of letters or marks alone, many in one call: each ends with the one token that ends a word. And of other chunks."""
        core = self.core
        for k in range(0, len(cores), 200_000):
            groups = [cores[i : i + 256] for i in range(k, min(k + 200_000, len(cores)), 256)]
            for g, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.end[ids]) + 1
                if len(ends) != len(g):
                    others = others + g
                    continue
                data, a = ids.tobytes(), 0
                for c, z in zip(g, (4 * ends).tolist(), strict=True):
                    core[c] = data[a:z]
                    a = z
        for k in range(0, len(others), 20_000):
            some = others[k : k + 20_000]
            for c, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                core[c] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        kept, core = self.kept, self.core
        if len(kept) > KEPT:
            kept.clear()
        if len(core) > KEPT:
            core.clear()
            core[""] = b""
        # A line's end is white space to the normaliser as a space is: cutting there leaves fewer distinct chunks.
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(kept)
        # A chunk of letters with marks after them has the ids of the small letters and of the marks.
        cut = {c: (m[1].lower(), m[2]) for c in new if (m := _PLAIN(c))}
        whole = [c for c in new if c not in cut]
        self.learn(list({x for xs in cut.values() for x in xs if x not in core}), [c for c in whole if c not in core])
        own: dict[str, bytes] = {}
        for c, (a, z) in cut.items():
            (kept if len(c) <= 64 else own)[c] = core[a] + core[z]
        for c in whole:
            (kept if len(c) <= 64 else own)[c] = core[c]
        if own:
            return [b"".join([kept[c] if c in kept else own[c] for c in parts]) for parts in split]
        return [b"".join(map(kept.__getitem__, parts)) for parts in split]


def chunks(path: str) -> Chunks:
    return kept(("chunks", path), lambda: Chunks(path))


def combinations(window: int, step: int) -> list[tuple[tuple[int, int], ...]]:
    """Shallow fillings of a window, each as ((length, times), ...): every pair, every length up to eight times with the
    length that then fills up, and triples of lengths on a grid."""
    found = {tuple(sorted((a, window - a))) for a in range(1, window // 2 + 1)}
    for times in range(2, 9):
        for a in range(1, (window - 1) // times + 1):
            found.add(tuple(sorted((*[a] * times, window - times * a))))
    for a in range(step, window, step):
        for b in range(a, window - a, step):
            if window - a - b >= b:
                found.add((a, b, window - a - b))
    out = []
    for c in sorted(found):
        if min(c) > 0:
            out.append(tuple((x, c.count(x)) for x in sorted(set(c))))
    return out


def nnls(columns: list[tuple[tuple[int, int], ...]], target: np.ndarray, sweeps: int = 40, still: float = 0.25) -> np.ndarray:
    """x >= 0 that makes the sum of x[j] * columns[j] near the target by least squares: cyclic coordinate descent, until no
    count moves by `still`."""
    rest, x = target.astype(float).copy(), np.zeros(len(columns))
    norm = [sum(t * t for _, t in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = max(-x[j], sum(t * rest[a] for a, t in c) / norm[j])
            if step:
                x[j] += step
                for a, t in c:
                    rest[a] -= step * t
                moved = max(moved, abs(step))
        if moved < still:
            break
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int, int]], np.ndarray]:
    """Rows (length, lo, hi, first sequence, times, offset): the rests of that length whose rank is in [lo, hi) go, `times`
    to a sequence, to sequences counted from the first, one after another from the offset. And how many of each length are placed so."""
    columns = combinations(window, max(1, window // 32))
    columns = [c for c in columns if all(histogram[a] >= t for a, t in c)]
    x = nnls(columns, histogram)
    left, rows, used, seq = histogram.copy(), [], np.zeros_like(histogram), 0
    for j in np.argsort(-x, kind="stable"):
        c = columns[j]
        n = min(int(x[j] + 0.5), *(int(left[a]) // t for a, t in c))
        if n <= 0:
            continue
        at = 0
        for a, t in c:
            rows.append((a, int(used[a]), int(used[a]) + n * t, seq, t, at))
            used[a] += n * t
            left[a] -= n * t
            at += a * t
        seq += n
    return rows, used


def pack(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. path: a tokenizer file that
    every executor has."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    tail = np.array([end_id], "<u4").tobytes()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen, wide = chunks(path), np.zeros(window, np.int64), window * 4
        for b in slices(batches, 2000, 6 << 20):
            n, rank, crc, grid, full = [], [], [], [], []
            for ids in c.encode([x or "" for x in b.column(1).to_pylist()]):
                ids += tail
                n.append(len(ids) // 4)
                whole = len(ids) // wide * wide
                full.append(np.array([zlib.crc32(ids[k : k + wide]) for k in range(0, whole, wide)], "<u4").tobytes())
                rest = ids[whole:]
                rank.append(seen[len(rest) // 4])
                seen[len(rest) // 4] += 1
                crc.append(zlib.crc32(rest))
                grid.append(np.array([zlib.crc32(rest[k : k + 4 * GRID]) for k in range(0, len(rest), 4 * GRID)], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(rank, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array(grid, pa.binary()), pa.array(full, pa.binary())
                ],
                names=["id", "part", "n", "rank", "crc", "grid", "full"],
            )

    kind = src.schema["id"].dataType.simpleString()
    base = save(
        src.mapInArrow(tokens, f"id {kind}, part int, n long, rank long, crc long, grid binary, full binary").withColumn(
            "rest", (F.col("n") % window).cast("int")
        ),
        "pack"
    )
    # A rest's rank among all rests of its length: those of earlier partitions, then its own partition's.
    counts = base.groupBy("part", "rest").agg(F.count("*").alias("c"))
    before = counts.select("part", "rest", (F.sum("c").over(Window.partitionBy("rest").orderBy("part")) - F.col("c")).alias("earlier"))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect():  # at most `window` rows
        histogram[r["rest"]] = r["c"]
    histogram[0] = 0
    rows, used = plan(histogram, window)
    placed = spark.createDataFrame(rows, "rest int, lo long, hi long, seq long, times long, at long")
    left = histogram - used
    first = spark.createDataFrame(
        [(k, int(used[k]), int(v)) for k, v in enumerate(np.cumsum(left) - left) if left[k]], "rest int, used long, index long"
    )
    n_planned = max([0, *(s + (hi - lo) // t for _, lo, hi, s, t, _ in rows)])
    rests = base.filter("rest > 0").drop("full").join(before, ["part", "rest"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    # Both tables have a few thousand rows at most, whatever the input: one or a few for each length.
    inside = rests.join(F.broadcast(placed), "rest").filter("rank >= lo and rank < hi")
    k = F.col("rank") - F.col("lo")
    inside = inside.select(
        "id", (
            F.col("n") - F.col("rest")
        ).alias("start"), F.col("rest").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.col("seq") + F.expr("(rank - lo) div times")).alias("sequence_id"), (F.col("at") + (k % F.col("times")) * F.col("rest")).alias("offset"),
    )
    over = rests.join(F.broadcast(first), "rest").filter("rank >= used").withColumn("index", F.col("index") + F.col("rank") - F.col("used"))
    over = over.select("id", "n", "rest", "grid", "index", F.expr(f"index div {LANE}").alias("lane"))

    def greedy(key, pdf):
        return fill(pdf, int(key[0]), window)

    out_type = T.StructType(
        [
            T.StructField("id", src.schema["id"].dataType),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
        ]
    )
    packed = over.groupBy("lane").applyInPandas(greedy, out_type)
    lane_span = 1 << 32  # no lane has as many sequences
    packed = packed.withColumn("sequence_id", F.lit(n_planned) + F.col("sequence_id"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = [np.frombuffer(x, "<u4") for x in b.column(2).to_pylist()]
            times = np.array([len(x) for x in crcs], np.int64)
            at = np.repeat(np.arange(len(crcs)), times)
            k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)), pa.array(k * window, pa.int64()), pa.array(np.full(len(k), window, np.int64)),
                    pa.array(np.concatenate([*crcs, np.zeros(0, "<u4")]).astype(np.int64)), b.column(1).take(pa.array(at))
                ],
                names=["id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    whole = base.filter(F.col("n") >= window).select("id", "n", "full").mapInArrow(
        windows, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )
    whole = whole.select("*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return finish(inside.unionByName(packed).unionByName(whole).withColumnRenamed("id", id_col), base)


def fill(pdf, lane: int, window: int):
    """Pack one lane: the longest rest that still fits goes in next; if none fits, the largest is cut on the grid and its
    last part opens the next sequence."""
    import pandas as pd

    pdf = pdf.sort_values("index", kind="stable")
    by: dict[int, list[int]] = {}
    for i, r in enumerate(pdf["rest"].tolist()):
        by.setdefault(r, []).append(i)
    ids, ns, rests, grids = pdf["id"].tolist(), pdf["n"].tolist(), pdf["rest"].tolist(), pdf["grid"].tolist()
    lengths = sorted(by)
    out, seq, at, left = [], lane * (1 << 32), 0, len(ids)
    carry: tuple[int, int] | None = None  # a document and where its unplaced part begins

    def emit(i: int, a: int, b: int) -> None:
        nonlocal at
        crcs = np.frombuffer(grids[i], "<u4").tolist()
        part = [(crcs[k], 4 * (min((k + 1) * GRID, rests[i]) - k * GRID)) for k in range(a // GRID, -(-b // GRID))]
        out.append((ids[i], ns[i] - rests[i] + a, b - a, crc_parts(part), ns[i], seq, at))
        at += b - a

    import bisect

    while left or carry:
        if carry:
            i, a = carry
            carry = None
            emit(i, a, rests[i])
        while left:
            room = window - at
            j = bisect.bisect_right(lengths, room) - 1
            if room == 0:
                break
            if j >= 0 and (lengths[j] == room or lengths[-1] <= room):
                n = lengths[j]
            elif room >= GRID:  # cut the longest
                n = lengths[-1]
            elif j >= 0:
                n = lengths[j]
            else:
                break
            i = by[n].pop()
            left -= 1
            if not by[n]:
                del by[n]
                lengths.remove(n)
            if n <= room:
                emit(i, 0, n)
            else:
                cut = room // GRID * GRID
                emit(i, 0, cut)
                carry = (i, cut)
                break
        seq, at = seq + 1, 0
    return pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

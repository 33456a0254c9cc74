"""Embedding near-dedup with an inverted multi-index.

Equal vectors are one class. Unit vectors are cut in halves; each half has a codebook of its own (k-means on a bounded
sample of at most SAMPLE classes; the number of codewords grows with the square root of the classes, up to a fourth of the sample), and pairs of codewords are the cells of a product grid, in which every class is indexed.
A query visits cells in the order of the multi-sequence traversal, that is by the sum of the distances to both codewords. How many, T, is
set so that TARGET of all links at the threshold itself (the hardest ones: simulated around sampled vectors, a link
counts if one end visits the other's cell) are met. Whatever is met is verified by its cosine in double precision.

A cell row (a codeword of the first half) whose residents are many is cut into chunks by the second codeword, and a visitor goes only
to the chunks of the cells that it visits. A cell with more than CHUNK residents is cut by their numbers, and its visitors
go to all of its parts; so what a task holds is bounded, and nothing is left out.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose id is null, link with
nothing; ties of distances to codewords go to the lower one; vectors of different lengths don't link, those of length 1 link if their signs are the same; rows with one id are vectors of their own; an empty table gives an
empty table; other columns are ignored. Beyond about 2 * 10^8 classes the codebooks stay at MOST_WORDS, which leaves what is found as it is
but makes cells fuller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finish, hash_order, save, spread
from .components import components

SAMPLE, TARGET, CHUNK, MOST_WORDS = 20_000, 0.97, 4096, 5000
#: Distances, or places of the traversal, that are held at once.
HELD = 2_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, words)
        n = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words[n > 0] = total[n > 0] / n[n > 0, None]
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest word of each row, in parts."""
    step = max(1, HELD // max(1, len(words)))
    return np.concatenate([squared(x[i : i + step], words).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None], 0)


class Index:
    """Both codebooks and T."""

    def __init__(self, sample: np.ndarray, n: int, least: float):
        self.half = sample.shape[1] // 2
        k = int(np.clip(np.sqrt(n / 8), 1, MOST_WORDS))
        self.first, self.second = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)
        self.visits = min(self.calibrate(sample, least), len(self.first) * len(self.second))
        # The places that can be among the first: a product of both places, from 1, of `visits` at most.
        some = [(a, b) for a in range(len(self.first)) for b in range(min(len(self.second), self.visits // (a + 1)))]
        self.places = np.array(some, np.int64).reshape(-1, 2)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.half], self.first), nearest(x[:, self.half :], self.second)

    def calibrate(self, sample: np.ndarray, least: float, queries: int = 1500) -> int:
        rng = np.random.default_rng(9)
        x = sample[rng.choice(len(sample), min(queries, len(sample)), replace=False)]
        u = rng.normal(size=x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        y = least * x + np.sqrt(1 - least * least) * u
        ranks = []
        for p, q in ((x, y), (y, x)):
            i, j = self.home(q)
            rank = []
            for k in range(len(p)):  # how many cells are nearer than the other's
                a, b = (d[0] for d in self.distances(p[k : k + 1]))
                rank.append(1 + int(np.searchsorted(np.sort(b), a[i[k]] + b[j[k]] - a, "left").sum()))
            ranks.append(rank)
        return int(np.quantile(np.minimum(*ranks), TARGET)) + 1

    def visited(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, i, j): the first T cells of each vector's multi-sequence. With both halves' codewords sorted by distance, a
        cell of places (a, b) is among the first T only if (a + 1) * (b + 1) <= T."""
        step = max(1, HELD // max(len(self.first), len(self.places)))
        parts = [self.visited_by(x[i : i + step]) for i in range(0, len(x), step)]
        return np.concatenate(
            [r + k * step for k, (r, _, _) in enumerate(parts)]
        ), np.concatenate([i for _, i, _ in parts]), np.concatenate([j for *_, j in parts])

    def visited_by(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        da, db = self.distances(x)
        oa, ob = np.argsort(da, 1), np.argsort(db, 1)
        t, (pa_, pb) = self.visits, self.places.T
        cost = np.take_along_axis(da, oa, 1)[:, pa_] + np.take_along_axis(db, ob, 1)[:, pb]
        pick = np.argpartition(cost, t - 1, 1)[:, :t] if t < cost.shape[1] else np.tile(np.arange(cost.shape[1]), (len(x), 1))
        row = np.repeat(np.arange(len(x)), pick.shape[1])
        return row, oa[row, pa_[pick.ravel()]], ob[row, pb[pick.ravel()]]


class Spots:
    """The chunk of each cell: a row's cells are dealt to its chunks by their second codeword; a full cell has parts of its own."""

    def __init__(self, chunks: np.ndarray, width: int, full: dict[tuple[int, int], int]):
        self.chunks, self.width = chunks, width
        cells = sorted((i * width + j, n) for (i, j), n in full.items())
        self.cells, self.parts = np.array([c for c, _ in cells], np.int64), np.array([n for _, n in cells], np.int64)

    def parts_of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many parts each cell has; 0: none of its own."""
        if not len(self.cells):
            return np.zeros(len(i), np.int64)
        cell = i.astype(np.int64) * self.width + j
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, self.parts[at], 0)

    def named(self, i: np.ndarray, j: np.ndarray, parts: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.where(parts > 0, (j.astype(np.int64) + 1 << 32) + part, j % self.chunks[i])

    def of_homes(self, i: np.ndarray, j: np.ndarray, rep: np.ndarray) -> np.ndarray:
        parts = self.parts_of(i, j)
        spread = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return self.named(i, j, parts, spread % np.maximum(parts, 1))

    def of_visits(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(visit, chunk): each visit with every chunk that holds residents of its cell."""
        parts = self.parts_of(i, j)
        times = np.maximum(parts, 1)
        k = np.repeat(np.arange(len(i)), times)
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return k, self.named(i[k], j[k], parts[k], part)


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that squares neither vanish nor overflow."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def dense(b: pa.RecordBatch, column: int) -> np.ndarray:
    rows = b.column(column)
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def link(classes: DataFrame, dim: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(u, v): linked classes of one length; classes: rep, vector. And the table that it is made from."""
    spark = classes.sparkSession
    mine = classes.filter(F.size("vector") == dim)
    n = mine.count()
    sample = mine.select("rep", "vector", hash_order(F.col("rep")).alias("h")).filter(
        (F.col("h") / 2.0**64 + 0.5) * n < 2 * SAMPLE + 100
    ).orderBy("h", "rep").limit(SAMPLE).collect()
    index = Index(unit(np.array([r["vector"] for r in sample])), n, least)
    shared = spark.sparkContext.broadcast(index)  # 2 * MOST_WORDS half vectors at most

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(dense(b, 1))
                i, j = shared.value.home(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["rep", "i", "j", "unit"]
                )

    homes = save(mine.select("rep", "vector").mapInArrow(home, "rep long, i int, j int, unit binary"), "homes")
    chunks = np.ones(len(index.first), np.int64)
    for r in homes.groupBy("i").count().collect():  # at most MOST_WORDS rows
        chunks[r["i"]] = -(-r["count"] // CHUNK)
    # Cells of more than CHUNK residents: at most one for each CHUNK classes.
    full = homes.groupBy("i", "j").count().filter(F.col("count") > CHUNK).collect()
    spots = Spots(chunks, len(index.second), {(r["i"], r["j"]): -(-r["count"] // CHUNK) for r in full})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["i", "chunk", "visit", "rep", "js", "unit"]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                rep, i, j, data = some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2).to_numpy(), some.column(3).to_pylist()
                x = np.frombuffer(b"".join(data), np.float64).reshape(len(rep), -1)
                row, vi, vj = shared.value.visited(x)
                # A visit for each part of the cell; those of one vector and chunk travel together.
                k, chunk = spots.of_visits(vi, vj)
                row, vi, vj = row[k], vi[k], vj[k]
                order = np.lexsort((vj, chunk, vi, row))
                row, vi, vj, chunk = row[order], vi[order], vj[order], chunk[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (vi[1:] != vi[:-1]) | (chunk[1:] != chunk[:-1])])
                js = [x.astype("<i4").tobytes() for x in np.split(vj, new[1:])]
                row, vi, chunk = row[new], vi[new], chunk[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(i), pa.array(spots.of_homes(i, j, rep)), pa.array(np.zeros(len(rep), np.int32)), pa.array(rep),
                        pa.array([k.tobytes() for k in j.astype("<i4")], pa.binary()), pa.array(data, pa.binary())
                    ],
                    names=names
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(vi.astype(np.int32)), pa.array(chunk), pa.array(np.ones(len(row), np.int32)), pa.array(rep[row]),
                        pa.array(js, pa.binary()), pa.array([data[k] for k in row], pa.binary())
                    ],
                    names=names
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, cells = None, [], None

        def settle() -> dict[int, tuple[np.ndarray, np.ndarray]]:
            by: dict[int, list] = {}
            for r, j, u in held:
                by.setdefault(int(np.frombuffer(j, "<i4")[0]), []).append((r, u))
            return {
                j: (np.array([r for r, _ in xs]), np.frombuffer(b"".join(u for _, u in xs), np.float64).reshape(len(xs), -1)) for j, xs in by.items()
            }

        def visit(group: list[tuple[int, bytes, bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
            us, vs = [], []
            by: dict[int, list[int]] = {}
            for k, (_, js, _u) in enumerate(group):
                for j in np.frombuffer(js, "<i4").tolist():
                    if j in cells:
                        by.setdefault(j, []).append(k)
            rep = np.array([r for r, *_ in group])
            x = np.frombuffer(b"".join(u for *_, u in group), np.float64).reshape(len(group), -1)
            for j, ks in by.items():
                own, y = cells[j]
                for p in range(0, len(ks), 512):
                    some = np.array(ks[p : p + 512])
                    a, c = np.nonzero(x[some] @ y.T >= least)
                    u, v = rep[some[a]], own[c]
                    keep = u != v
                    us.append(np.minimum(u, v)[keep])
                    vs.append(np.maximum(u, v)[keep])
            return us, vs

        for b in batches:
            us, vs, group = [], [], []
            for i, c, late, rep, js, u in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (i, c) != at:
                    if group:
                        more = visit(group)
                        us, vs, group = us + more[0], vs + more[1], []
                    at, held, cells = (i, c), [], None
                if not late:
                    held.append((rep, js, u))
                    continue
                if cells is None:
                    cells, held = settle(), []
                group.append((rep, js, u))
            if group:
                more = visit(group)
                us, vs = us + more[0], vs + more[1]
            pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0) if us else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    dealt = homes.mapInArrow(deal, "i int, chunk long, visit int, rep long, js binary, unit binary")
    dealt = dealt.repartition(spread(spark), "i", "chunk").sortWithinPartitions("i", "chunk", "visit")
    return dealt.mapInArrow(meet, "u long, v long").distinct(), homes


def dedup(vectors: DataFrame, id_col: str, vec_col: str, least: float = 0.9) -> DataFrame:
    """For each row: its id, n_links, component_id and kept (whether it is the one of its component that stays)."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    sound = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "vector", lambda x: x != 0
    )
    # A vector of one component is its sign: all of one sign link, so they are one class.
    bare = F.when(F.size("vector") == 1, F.transform("vector", F.signum)).otherwise(F.col("vector"))
    src = src.withColumn("vector", F.when(sound & F.col("id").isNotNull(), bare))
    classes = save(
        src.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("least_id"), F.count("*").alias("n")).withColumn(
            "rep", F.monotonically_increasing_id()
        ),
        "classes"
    )
    links, used = None, [classes]
    for r in classes.select(F.size("vector").alias("d")).distinct().collect():  # one row for each length of vectors
        if r["d"] > 1:  # both signs of one component don't link
            own, homes = link(classes, r["d"], least)
            used.append(homes)
            links = own if links is None else links.unionByName(own)
    if links is None:
        links = src.sparkSession.createDataFrame([], "u long, v long")
    links = save(links, "links")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.join(classes.select(F.col("rep").alias("v"), "n"), "v").groupBy("u").agg(F.sum("n").alias("more"))
    labels = components(links)
    used += [links, labels]
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "rep", "vector", "n", "least_id", F.coalesce("component", "rep").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "label").join(degree, named["rep"] == degree["u"], "left").select(
        "vector", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id"
    )
    out = src.join(named, "vector", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    out = out.select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
    return finish(out, *used)

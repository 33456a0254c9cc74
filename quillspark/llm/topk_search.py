"""Exact top-k search by inner product, in three phases with a uniform threshold.

A vector's components are dealt to LISTS lists; a list's local score is the inner product over its components, and a
vector's score is the sum over the lists. Phase 1 gathers, for each query and list, at least the k best local entries of each block
of vectors and their whole scores; the k-th best of these is a lower bound of the k-th best overall. Phase 2 sends that
bound to all blocks: a vector that reaches it must reach the LISTS-th part of it in one list at least, so entries
at or above this uniform cutoff suffice. Queries whose bound a block's lengths by list can't reach pass it over. Phase 3 resolves what the other lists add for these entries exactly, drops what stays
below the bound, and ranks the rest. Queries are few, stated rows; they meet the vectors block by block, never row by row.

Integer arithmetic is exact: in 32-bit floating point where no sum can leave 24 bits, in 64-bit where none can leave 53, else in
64-bit integers, which the scores must fit.

Defined results: vectors that are null, empty or hold null or non-finite components, or whose id is null, take no part; vectors of different
lengths aren't compared; every row counts, also rows of one id and rows repeated whole, as
queries and as candidates of other ids: a query id has the k best of what all its rows give; fewer than k candidates are all
returned; components or scores that could leave 64 bits end in an error that says so; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import finish, save, spread

LISTS = 4
#: Rows of a block of vectors, and of a block of queries.
BLOCK, QUERIES = 8192, 1024


def blocks_of(vectors: DataFrame, scale: int, most: int) -> DataFrame:
    """(dim, block, ids, data): dense blocks of at most `most` integer vectors, in the smallest integers that hold them. vectors: id and vector;
    rows of an id come together, in order of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal number
            rows = sorted(held.pop(dim), key=lambda r: r[0])
            number += 1
            ids, data = np.array([i for i, _ in rows], np.int64), np.stack([v for _, v in rows])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([dim], pa.int32()), pa.array([part << 24 | number], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
                    pa.array([narrow(data).tobytes()], pa.binary())
                ],
                names=["dim", "block", "ids", "data"]
            )

        for b in batches:
            ends = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            whole = np.floor(scale * raw)
            if np.abs(whole).max(initial=0) >= 1 << 62:
                raise ValueError("components are too large for whole numbers of 64 bits; scale the vectors")
            whole = whole.astype(np.int64)
            for k, (i, z) in enumerate(zip(b.column(0).to_pylist(), ends.tolist(), strict=True)):
                a = ends[k - 1] if k else 0
                v = whole[a:z]
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= most:
                    yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    return vectors.mapInArrow(run, "dim int, block long, ids binary, data binary")


def narrow(data: np.ndarray) -> np.ndarray:
    return data.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.array_equal(data.astype(k), data)))


def dense(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block; the width of its integers follows from its size."""
    n = len(ids) // 8
    return np.frombuffer(ids, np.int64), np.frombuffer(data, f"i{len(data) // (n * dim)}").astype(np.int64).reshape(n, dim)


def exact(q: np.ndarray, v: np.ndarray) -> type:
    most = max(1, q.shape[1]) * (int(np.abs(q).max(initial=0)) + 1) * (int(np.abs(v).max(initial=0)) + 1)
    if most >= 1 << 63:
        raise ValueError("scores could leave 64 bits; scale the vectors")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def lists_of(d: int) -> list[tuple[int, int]]:
    cuts = [d * k // LISTS for k in range(LISTS + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def lengths(x: np.ndarray) -> np.ndarray:
    """The length of each list of each row."""
    return np.stack([np.linalg.norm(x[:, a:z].astype(float), axis=1) for a, z in lists_of(x.shape[1])], 1)


def local_scores(q: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """For each list the local scores, queries by vectors; both of the type that exact() gives."""
    return [q[:, a:z] @ v[:, a:z].T for a, z in lists_of(q.shape[1])]


def among_best(score: np.ndarray, k: int) -> np.ndarray:
    """Which entries of each row reach a mark that at least k of it reach: the k-th highest of the tops of runs of columns."""
    n = score.shape[1]
    run = max(1, n // (16 * k))
    if n // run <= k:
        return np.ones(score.shape, bool)
    tops = score[:, : n // run * run].reshape(len(score), -1, run).max(2)
    at = tops.shape[1] - k
    return score >= np.partition(tops, at, 1)[:, at, None]


def search(vectors: DataFrame, id_col: str, vec_col: str, query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """For each query its k best other vectors: query_id, rank, vec_id, score. query: which rows are queries."""
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("query"), v.alias("vector"))
    sound = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = src.filter(F.col("id").isNotNull() & sound & (F.size("vector") > 0))
    # Cells of a grid: vectors go to one row of cells, queries to one column. Its shape moves the least data if each
    # vector goes to h cells and each query to g, with N * h = Q * g.
    n, n_asked = src.agg(F.count("*"), F.count_if("query")).first()
    parts = spread(spark)
    h = max(1, round((parts * max(1, n_asked) / max(1, n)) ** 0.5))
    g = max(1, parts // h)
    order = ["id", "vector"]
    rows = save(blocks_of(src.select(*order).repartition(parts, "id").sortWithinPartitions(*order), scale, BLOCK), "vectors")
    asks = save(
        blocks_of(src.filter("query").select(*order).repartition(-(-n_asked // QUERIES) or 1, "id").sortWithinPartitions(*order), scale, QUERIES),
        "queries"
    )
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    left = rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda c: spot("block", g) * h + c)))

    def pairs(asked: DataFrame) -> DataFrame:
        """Blocks that meet in a cell. Merged: the queries go to g cells each, far more than the size of their table lets a broadcast expect."""
        right = asked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda c: c * h + spot("asked", h))))
        return left.drop("block").join(right.hint("merge"), ["dim", "cell"]).drop("cell", "asked")

    asked = asks.select("dim", F.col("block").alias("asked"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def decode(b: pa.RecordBatch, k: int):
        get = lambda c: b.column(c)[k].as_py()
        return *dense(get("ids"), get("data"), get("dim")), *dense(get("q_ids"), get("q_data"), get("dim"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                ids, v, q_ids, q = decode(b, j)
                kind = exact(q, v)
                q, v = q.astype(kind), v.astype(kind)
                for i in range(0, len(q), 128):
                    local, own = local_scores(q[i : i + 128], v), q_ids[i : i + 128]
                    self = ids[None, :] == own[:, None]
                    chosen = np.zeros(self.shape, bool)
                    for s in local:
                        s[self] = s.min() - 1
                        chosen |= among_best(s, k)
                    chosen[self] = False
                    r, c = np.nonzero(chosen)
                    # Whole scores of the gathered entries only; a block's k best of them are all that can raise the bound.
                    score = np.sum([s[r, c].astype(np.int64) for s in local], 0, dtype=np.int64)
                    order = np.lexsort((-score, r))
                    r, score = r[order], score[order]
                    head = np.searchsorted(r, r)
                    top = np.arange(len(r)) - head < k
                    yield pa.RecordBatch.from_arrays([pa.array(own[r[top]]), pa.array(score[top])], names=["query_id", "score"])

    def keep_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query within a task, before they are dealt out."""
        import pandas as pd

        held = pd.DataFrame({"query_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        for b in entries(batches):
            held = pd.concat([held, b.to_pandas()])
            if len(held) > 200_000:
                held = held.sort_values("score", ascending=False).groupby("query_id").head(k)
        held = held.sort_values("score", ascending=False).groupby("query_id").head(k)
        yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    gathered = pairs(asked).mapInArrow(keep_best, "query_id long, score long")
    bounds = save(top_bound(gathered, k), "bounds")
    # Bounds go to their block of queries before it meets vectors, so nothing that grows with the queries is broadcast.
    own = asked.select("asked", "q_ids").mapInArrow(spell, "asked long, query_id long").distinct()
    per_block = own.join(bounds.hint("merge"), "query_id", "left").groupBy("asked").agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", "bound"))).alias("bounds")
    )
    bounded = asked.join(per_block.hint("merge"), "asked")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                ids, v, q_ids, q = decode(b, j)
                low = np.iinfo(np.int64).min
                known = {a: low if z is None else z for a, z in b.column("bounds")[j].as_py()}
                # Lists of a query and of a block's vectors are at most the product of their lengths.
                most = np.array([known[x] for x in q_ids.tolist()], float)
                some = (lengths(q) @ lengths(v).max(0)) * (1 + 1e-9) + 1 >= most
                kind = exact(q, v)
                q, q_ids, v = q[some].astype(kind), q_ids[some], v.astype(kind)
                for i in range(0, len(q), 128):
                    local, own = local_scores(q[i : i + 128], v), q_ids[i : i + 128]
                    floor = np.array([known[x] for x in own.tolist()], np.int64)[:, None]
                    enough = np.zeros(local[0].shape, bool)
                    # The uniform cutoff: bound / LISTS, rounded up as scores are whole. A cutoff or bound that floats round is beyond all scores.
                    cutoff = (floor // LISTS + (floor % LISTS > 0)).astype(local[0].dtype)
                    for s in local:
                        enough |= s >= cutoff
                    whole = np.sum(local, 0, dtype=local[0].dtype)
                    enough &= whole >= floor.astype(whole.dtype)
                    r, c = np.nonzero(enough)
                    alien = ids[c] != own[r]
                    r, c = r[alien], c[alien]
                    score = whole[r, c].astype(np.int64)
                    order = np.lexsort((ids[c], -score, r))
                    r, c, score = r[order], c[order], score[order]
                    top = np.arange(len(r)) - np.searchsorted(r, r) < k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[r[top]]), pa.array(ids[c[top]]), pa.array(score[top])], names=["query_id", "vec_id", "score"]
                    )

    last = pairs(bounded).mapInArrow(resolve, "query_id long, vec_id long, score long")
    # A query has about k entries at or above its bound, whatever the number of vectors; a block sends k at most.
    ranked = last.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k).alias("best")
    )
    out = ranked.select("query_id", F.posexplode("best").alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.down")).alias("score")
    )
    return finish(out, rows, asks, bounds)


def top_bound(gathered: DataFrame, k: int) -> DataFrame:
    """(query_id, bound): the k-th highest gathered score, null if there are fewer."""
    many = gathered.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    return many.select("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).alias("bound"))


def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            ids = np.frombuffer(b.column(1)[k].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), b.column(0)[k].as_py(), np.int64)), pa.array(ids)], names=["asked", "query_id"]
            )

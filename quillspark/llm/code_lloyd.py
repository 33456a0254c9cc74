"""Vector code compression: product codes learnt by Yinyang Lloyd rounds in whole numbers.

Components become floor(scale * x); a vector is cut into `parts` consecutive parts, each position with a codebook of its own, which starts as that part of
the vectors with the smallest ids. A round assigns every part to its nearest entry and moves each entry to the floor of its parts' mean; entries
without parts stay.

A codebook's entries are clustered into GROUPS groups once. Each part of a vector carries its entry and, for each
group, a lower bound on its distance to the group's other entries. When entries have moved, a bound falls by the largest drift in its group,
and a group is scanned only if its bound no longer exceeds the distance to the own entry. Bounds are 32-bit and rounded down, so
they only ever cause more scans; what is scanned is compared by whole squared distances, ties to the lower entry, so the result is that of
plain Lloyd rounds. Vectors with their bounds are a written table that each round reads and writes anew; a batch's sums by entry
are further rows of it, added up by Spark; the driver sees codebooks only.

Defined results: vectors that are null, empty or hold null or non-finite components, or whose id is null, are dropped, and so are those of
another length than the vector with the smallest id. A length that `parts` doesn't divide gives the first parts a component more; with
fewer components than parts, the last parts are empty. Fewer vectors than entries give smaller codebooks. Rows of one id are vectors of their own (the start takes them in order of their
components). Labels that are null count as one. Components whose distances could leave 63 bits (beyond 92,000 or so at scale 4096 and 64 components)
end in an error that says so. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import finish, forget, quoted, save

GROUPS, ROWS, SALT = 4, 4096, 16


def cuts_of(dim: int, parts: int) -> list[tuple[int, int]]:
    ends = np.cumsum([0] + [dim // parts + (k < dim % parts) for k in range(parts)]).tolist()
    return list(zip(ends[:-1], ends[1:], strict=True))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole squared distances, rows of x by rows of c: in 64-bit floating point where all of them stay exact, else in integers."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0)) + 1
    if most * most * max(1, x.shape[1]) >= 1 << 63:
        raise ValueError("components are too large for whole squared distances of 63 bits; scale the vectors")
    if most * most * max(1, x.shape[1]) < 1 << 51:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return ((x[:, None, :] - c[None]) ** 2).sum(2)


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each entry: farthest-point seeds, then a few rounds of means; any grouping gives the same codes."""
    c = entries.astype(float)
    seeds = [0]
    while len(seeds) < min(GROUPS, len(c)):
        seeds.append(int(((c[:, None] - c[seeds][None]) ** 2).sum(2).min(1).argmax()))
    means = c[seeds]
    for _ in range(5):
        near = ((c[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([c[near == g].mean(0) if (near == g).any() else means[g] for g in range(len(means))])
    return near


class Codebooks:
    """One codebook for each part: entries, their groups, and each group's drift in the last round."""

    def __init__(self, entries: list[np.ndarray], cuts: list[tuple[int, int]]):
        self.entries, self.cuts = entries, cuts
        self.groups = [grouped(c) for c in entries]
        self.drift = [np.zeros(GROUPS) for _ in entries]

    def move(self, total: np.ndarray, n: np.ndarray) -> None:
        """Entries become the floor of their parts' means; total: dim x entries sums by part, n: parts x entries."""
        at = 0
        for p, (a, z) in enumerate(self.cuts):
            old = self.entries[p]
            size = old.size
            new, used = total[at : at + size].reshape(old.shape), n[p, : len(old)]
            at += size
            moved = np.where(used[:, None] > 0, np.floor_divide(new, np.maximum(used, 1)[:, None]), old)
            step = np.sqrt(((moved - old).astype(float) ** 2).sum(1)) * (1 + 1e-9)
            self.drift[p] = np.array([step[self.groups[p] == g].max(initial=0) for g in range(GROUPS)])
            self.entries[p] = moved

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for c in self.entries for v in c.ravel().tolist()).encode()).hexdigest()


def down(x: np.ndarray) -> np.ndarray:
    """32-bit values not above x."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def assign(x: np.ndarray, codes: np.ndarray | None, bounds: np.ndarray | None, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, bounds, squared distances, scanned pairs) of whole vectors; codes and bounds: those of the last round, None at first."""
    n, parts = len(x), len(books.cuts)
    new_codes, new_bounds, error = np.zeros((n, parts), np.uint8), np.full((n, parts, GROUPS), np.float32(np.inf)), np.zeros((n, parts), np.int64)
    scanned = 0
    for p, (a, z) in enumerate(books.cuts):
        v, c, group = x[:, a:z], books.entries[p], books.groups[p]
        if codes is None:
            best, code = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
            bound = np.full((n, GROUPS), -np.inf)
        else:
            code = codes[:, p].astype(np.int64)
            best = own_squares(v, c[code])
            bound = bounds[:, p].astype(float) - books.drift[p][None]
        reach = np.sqrt(np.where(best == np.iinfo(np.int64).max, np.inf, best.astype(float))) * (1 + 1e-9)
        start, first = code.copy(), best.copy()
        low = bound.copy()
        scans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for g in range(GROUPS):
            members = np.flatnonzero(group == g)
            if not len(members):
                low[:, g] = np.inf
                continue
            # A tie counts, so the bound must exceed the distance to the entry of the last round.
            rows = np.flatnonzero(bound[:, g] <= reach)
            if not len(rows):
                continue
            d = squares(v[rows], c[members])
            scanned += d.size
            scans.append((rows, members, d))
            k = d.argmin(1)  # the lowest entry of several
            near, entry = d[np.arange(len(rows)), k], members[k]
            better = (near < best[rows]) | ((near == best[rows]) & (entry < code[rows]))
            best[rows[better]], code[rows[better]] = near[better], entry[better]
        for rows, members, d in scans:
            # The bound is on all of the group but the entry that the part has now.
            others = np.where(members[None] == code[rows][:, None], np.inf, np.sqrt(d.astype(float)))
            low[rows, group[members[0]]] = others.min(1) * (1 - 1e-9)
        left = np.flatnonzero(code != start) if codes is not None else np.zeros(0, np.int64)
        # An entry that a part left counts in its group's bound from now on.
        low[left, group[start[left]]] = np.minimum(low[left, group[start[left]]], np.sqrt(first[left].astype(float)) * (1 - 1e-9))
        new_codes[:, p], new_bounds[:, p], error[:, p] = code, down(low), best
    return new_codes, new_bounds, error, scanned


def own_squares(v: np.ndarray, own: np.ndarray) -> np.ndarray:
    return ((v - own) ** 2).sum(1)


def sums(x: np.ndarray, codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """Component sums by part and entry, then the counts (parts x the largest codebook), as one row of whole numbers."""
    out, counts = [], []
    for p, (a, z) in enumerate(books.cuts):
        c = books.entries[p]
        one = np.zeros((len(x), len(c)), np.int64)
        one[np.arange(len(x)), codes[:, p]] = 1
        out.append((one.T @ x[:, a:z].astype(np.int64)).ravel())
        counts.append(one.sum(0))
    return np.concatenate([*out, *counts])


#: A vector with its codes and bounds, or (with sums) what a batch of them adds up to.
STATE = "id long, label {}, data binary, codes binary, bounds binary, error long, scanned long, sums array<long>"


def compress(
    vectors: DataFrame, id_col: str, vec_col: str, label: Column | None = None, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    scans: list[int] | None = None
) -> DataFrame:
    """For each kept row: its id, code (hex), error, label_error and codebooks_sha256. label: whose rows' errors are summed. scans: takes the
    number of distances that each assignment's scans worked out."""
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    src = vectors.select(
        F.col(id_col).cast("long").alias("id"), (F.lit(None).cast("long") if label is None else label).alias("label"), v.alias("vector")
    )
    sound = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = src.filter(F.col("id").isNotNull() & sound & (F.size("vector") > 0))
    head = src.select("id", "vector").orderBy("id", "vector").limit(entries).collect()
    if not head:
        return spark.createDataFrame([], f"{quoted(id_col)} long, code string, error long, label_error long, codebooks_sha256 string")
    dim = len(head[0]["vector"])
    same = src.filter(F.size("vector") == dim)
    if any(len(r["vector"]) != dim for r in head):
        head = same.select("id", "vector").orderBy("id", "vector").limit(entries).collect()
    first = np.floor(scale * np.array([r["vector"] for r in head])).astype(np.int64)
    cuts = cuts_of(dim, parts)
    books = Codebooks([first[:, a:z].copy() for a, z in cuts], cuts)
    kind = src.schema["label"].dataType
    limit = np.sqrt(2.0**60 / max(1, -(-dim // parts)))  # whole components fit 32 bits as well

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, None, None]]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                raw = some.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = np.floor(scale * raw)
                if np.abs(x).max(initial=0) >= limit:
                    raise ValueError("components are too large for whole squared distances of 63 bits; scale the vectors")
                yield some.column(0), some.column(1), x.astype(np.int64), None, None

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                get = lambda k, kind: np.frombuffer(b"".join(some.column(k).to_pylist()), kind)  # noqa: B023, E731
                yield (
                    some.column(0), some.column(1), get(2, np.int32).reshape(-1, dim).astype(np.int64), get(3, np.uint8).reshape(-1, parts),
                    get(4, np.float32).reshape(-1, parts, GROUPS)
                )

    def step(rows: DataFrame, read, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(books)  # parts codebooks of `entries` entries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["id", "label", "data", "codes", "bounds", "error", "scanned", "sums"]
            for ids, labels, x, codes, bounds in read(batches):
                if not len(x):
                    continue
                codes, bounds, error, scanned = assign(x, codes, bounds, shared.value)
                n, total = len(x), pa.array([None] * len(x), pa.list_(pa.int64()))
                lost = pa.array([None] * n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, labels, lost if last else pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()),
                        lost if last else pa.array([r.tobytes() for r in bounds], pa.binary()), pa.array(error.sum(1)), pa.array(np.zeros(n, np.int64)), total
                    ],
                    names=names
                )
                own = pa.array([sums(x, codes, shared.value)], pa.list_(pa.int64()))
                none = [pa.array([None], t) for t in (pa.int64(), labels.type, pa.binary(), pa.binary(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([scanned], pa.int64()), own], names=names)

        out = save(rows.mapInArrow(run, STATE.format(kind.simpleString())), "codes")
        if scans is not None:
            scans.append(out.filter("sums is not null").agg(F.sum("scanned")).first()[0])
        return out

    table = step(same, whole, rounds == 0)
    for k in range(rounds):
        # One number for each component of each entry, whatever the number of vectors.
        flat = table.filter("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        total = np.array([r["x"] for r in sorted(flat, key=lambda r: r["at"])], np.int64)
        size = sum(c.size for c in books.entries)
        books.move(total[:size], total[size:].reshape(parts, -1))
        rows = table.filter("sums is null").select("id", "label", "data", "codes", "bounds")
        after = step(rows, again, k + 1 == rounds)
        forget(table)
        table = after
    rows = table.filter("sums is null").select("id", "label", "codes", "error", F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("salt"))
    # A label may hold a third of all rows: its rows are dealt to SALT parts for the join.
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", salts)
    both = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")) & (rows["salt"] == by_label["salt"]))
    pairs = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda k: F.lower(F.hex(F.substring("codes", k, F.lit(1)))))
    out = both.select(
        F.col("id").alias(id_col), F.array_join(pairs, "").alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
    return finish(out, table)

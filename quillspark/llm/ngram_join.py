"""N-gram Jaccard join by prefix filters under several global orders.

A document's set holds the hashes of its distinct word n-grams. Under any order of all tokens, two sets with a similarity
of t or more share a token among the first n - ceil(t n) + 1 of each. The orders here put rare tokens first (by counts in a
fixed number of hash buckets, so what is broadcast has one size whatever the input) and break ties by different hashes.

1. Each text is hashed once; its set is written. Equal sets are one class, of which one set goes on.
2. The first order's prefixes meet in lists, one for each token. They are longer than need be, so that linked sets share not
   one token there but more(): sets that share too few with all others together go before anything is compared.
3. Each list has a pivot, the class with the least hash; all classes whose lists have one pivot are its group. Two linked classes
   share a list, so they meet in a group. A task holds a group of up to `together` classes: pairs whose prefixes share a token under
   every order are candidates (the filters are intersected), and only these are verified.
4. A larger group is never compared pair by pair. Its classes go on as differences from the group's majority, the tokens that most of
   them hold; x and y differ by as much as their differences do, so they link if and only if room(x) + room(y) + overlap >= 0, where
   room() is what a set's own size allows less its differences. All that link by room alone link with the class of the most room: one
   link each. Any other link needs common differences, so prefixes of the differences meet in lists, which are at most
   half the group as no difference is held by more; lists with several components are groups of the next level.

No link between components is lost, and a group of many near copies costs about one comparison for each member.

Defined results: null, empty and blank texts have an empty set and link with nothing; documents with a null id link
with nothing and have a null component; rows with one id count as documents of their own; texts of any length are read whole; an empty
table gives an empty table; other columns are ignored, whatever their names. Sets are taken as equal if their 64-bit hashes are. An n-gram is
48 bits of its hash, so a text of m different ones is taken to have about m * m / 2 ** 49 fewer (0.7 for 20 million). A task that compares a
group holds up to `together` sets whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, forget, grams, mix, save, slices, spread, word_hashes
from .components import components, contract

#: Token counts are kept in 2 ** COUNT_BITS buckets, sent in SLICES parts; a bitmap of classes has 2 ** 15 bits in each of BITMAPS parts.
COUNT_BITS, SLICES, BITMAPS = 21, 64, 256
#: Classes that a task compares pair by pair.
TOGETHER = 512
#: Prefix keys that a task gathers before it sends them.
GATHER = 2_000_000
_LOW = np.uint64((1 << 48) - 1)
_SALTS = tuple(np.uint64(s) for s in (0x51ED27A1B5C34D77, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93))


def token_set(text: bytes, n: int) -> np.ndarray:
    """Distinct n-gram hashes (48 bits), sorted. A-Z count as small letters."""
    return np.unique(grams(word_hashes().of(text.lower().split()), n) & _LOW)


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def more(n: int, percent: int) -> int:
    """Tokens that two linked sets share in their prefixes, if each prefix is more() - 1 tokens longer than prefix_size();
    of sets of different sizes the smaller number holds."""
    return 1 + (100 - percent) * n // 200


def need(n: Column, percent: int) -> Column:
    """The least of more() over all sets that may link with one of size n: the smallest has percent / 100 of its size."""
    return 1 + F.floor(F.lit(100 - percent) * F.ceil(F.lit(percent) * n / 100) / 200)


def ordered(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Keys of the tokens under a global order: rare ones first, then by a hash of its own."""
    level = levels[(tokens & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(56)) | (mix(tokens ^ _SALTS[order]) >> np.uint64(8))


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, percent: int, longer: int = 0) -> np.ndarray:
    keys, p = ordered(tokens, levels, order), prefix_size(len(tokens), percent) + longer
    return keys if p >= len(keys) else np.partition(keys, p - 1)[:p]


def planes(tokens: np.ndarray, n: int = 6) -> bytes:
    """The n low bytes of values, byte by byte, so that the sorted high bytes compress."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unplanes(data: bytes, n: int = 6) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(n, -1)
    out = np.zeros((b.shape[1], 8), np.uint8)
    out[:, :n] = b.T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def describe(docs: DataFrame, n: int) -> DataFrame:
    """Rows (id, n, class, set) of the documents, a set that the task has written before left out, and rows (slice, counts) of the
    token counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, done = np.zeros(1 << COUNT_BITS, np.int64), set()
        names = ["id", "n", "class", "set", "slice", "counts"]
        for b in slices(batches):
            sizes, classes, sets, seen = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                s = token_set(t, n)
                c = class_of(s) if len(s) else None
                new = i is not None and c is not None and c not in done
                if new and len(done) < 200_000:
                    done.add(c)
                sizes.append(len(s))
                classes.append(c)
                sets.append(planes(s) if new else None)
                seen.append(s)
            counts += np.bincount((np.concatenate(seen) & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64), minlength=1 << COUNT_BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sets, pa.binary()),
                    pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
                ],
                names=names
            )
        if counts.any():
            parts = [np.minimum(x, 65535).astype("<u2").tobytes() for x in counts.reshape(SLICES, -1)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names
            )

    return docs.mapInArrow(run, "id long, n long, class long, set binary, slice int, counts binary")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(c, "<u2").astype(np.int64)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"]
        )


def count_levels(described: DataFrame) -> np.ndarray:
    """One byte for each bucket: eight steps for each doubling of its count."""
    parts = described.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(summed, "slice int, counts binary").collect()  # SLICES rows
    total = np.zeros((SLICES, (1 << COUNT_BITS) // SLICES), np.int64)
    for r in parts:
        total[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    return np.minimum(8 * np.log2(total.reshape(-1) + 1), 255).astype(np.uint8)


def postings(sets: DataFrame, levels, percent: int, buckets: int) -> DataFrame:
    """(bucket, token, class): prefix tokens under the first order and whose they are, packed by bucket of the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            tok, cls = np.concatenate(held), np.concatenate(owner)
            bucket = (tok % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tok, cls, bucket = tok[order], cls[order], bucket[order]
            own, first = np.unique(bucket, return_index=True)
            ends = [*first[1:].tolist(), len(tok)]
            arrays = [
                pa.array(own, pa.int32()), pa.array([planes(tok[a:z], 7) for a, z in zip(first, ends, strict=True)], pa.binary()),
                pa.array([cls[a:z].tobytes() for a, z in zip(first, ends, strict=True)], pa.binary())
            ]
            held.clear()
            owner.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["bucket", "token", "class"])

        for b in slices(batches):
            for c, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = unplanes(data)
                p = prefix(s, levels.value, 0, percent, more(len(s), percent) - 1) & np.uint64((1 << 56) - 1)
                held.append(p)
                owner.append(np.full(len(p), c, np.int64))
                count += len(p)
            if count > GATHER:
                count = 0
                yield flush()
        if held:
            yield flush()

    return sets.mapInArrow(run, "bucket int, token binary, class binary")


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class) for tokens that several classes have. Batches come with the rows of a bucket together."""

    def emit(toks: list[np.ndarray], clss: list[np.ndarray]) -> pa.RecordBatch:
        t, c = np.concatenate(toks), np.concatenate(clss)
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c = t[new], c[new]
        same = t[1:] == t[:-1]
        many = np.zeros(len(t), bool)
        many[1:] |= same
        many[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(t[many].astype(np.int64)), pa.array(c[many])], names=["token", "class"])

    at, toks, clss = None, [], []
    for b in batches:
        for k, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != at and toks:
                yield emit(toks, clss)
                toks, clss = [], []
            at = k
            toks.append(unplanes(t, 7))
            clss.append(np.frombuffer(c, np.int64))
    if toks:
        yield emit(toks, clss)


def those_in(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, n, set) of the wanted classes, one row each. A bitmap of a fixed size goes first, so that few others are shuffled."""
    bits = wanted.select(F.pmod("class", F.lit(BITMAPS)).cast("int").alias("part"), F.pmod(F.shiftright("class", 8), F.lit(1 << 15)).alias("bit"))
    rows = bits.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # BITMAPS rows of 4096 bytes
    flags = np.zeros((BITMAPS, 1 << 15), bool)
    for r in rows:
        flags[r["part"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    known = sets.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(0).to_numpy()
            yield b.filter(pa.array(known.value[c % BITMAPS, (c >> 8) % (1 << 15)]))

    return sets.select("class", "n", "set").mapInArrow(run, "class long, n long, set binary").join(
        wanted, "class", "left_semi"
    ).dropDuplicates(["class"])


def lists_of(keys: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Of each key that several rows hold, the rows."""
    flat, row = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    begin = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(flat)], strict=False):
        if z - a > 1:
            yield row[a:z]


def overlaps(keys: list[np.ndarray]) -> np.ndarray:
    """How many keys each two rows have in common."""
    out = np.zeros((len(keys), len(keys)), np.int32)
    for rows in lists_of(keys):
        out[rows[:, None], rows] += 1
    return out


def forest(links: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
    """(u, v): as many of the links (a matrix) as make the same components."""
    a, b = np.nonzero(np.triu(links, 1))
    edges = pa.RecordBatch.from_arrays([pa.array(classes[a]), pa.array(classes[b])], names=["u", "v"])
    return next(contract(iter([edges])))


def links_among(sets: list[np.ndarray], levels: np.ndarray, percent: int) -> np.ndarray:
    """Which sets link, as a matrix. Candidates share prefix tokens under all orders and fit in size; only they are verified."""
    size = np.array([len(s) for s in sets])
    ok = 100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)
    for k in range(len(_SALTS)):
        if not np.triu(ok, 1).any():
            return np.zeros_like(ok)
        ok &= overlaps([prefix(s, levels, k, percent) for s in sets]) > 0
    a, b = np.nonzero(np.triu(ok, 1))
    if len(a) <= 4 * len(sets):
        both = [np.sort(np.concatenate([sets[i], sets[j]])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        common = np.array([int((x[1:] == x[:-1]).sum()) for x in both], np.int64)
    else:
        # What two sets have in common follows from how they differ from the first, which is little where many are candidates.
        apart = [np.setxor1d(s, sets[0], assume_unique=True) for s in sets]
        far = np.array([len(d) for d in apart])
        common = ((size[:, None] + size - far[:, None] - far) // 2 + overlaps(apart))[a, b]
    good = 100 * common >= percent * (size[a] + size[b] - common)
    out = np.zeros_like(ok)
    out[a[good], b[good]] = True
    return out


_MET = "u long, v long, g long, class long, n long, diff array<long>"


def meet(levels, percent: int):
    """Links within the groups that one task holds whole, and differences from the pivot for the members of the others. Rows (g, parts,
    class, n, set) come by g (and part), the pivot first."""

    def links(pairs: pa.RecordBatch) -> pa.RecordBatch:
        n = pairs.num_rows
        return pa.RecordBatch.from_arrays(
            [*pairs.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
            names=["u", "v", "g", "class", "n", "diff"]
        )

    def settle(members: list[tuple[int, bytes]]) -> pa.RecordBatch:
        sets = [unplanes(s) for _, s in members]
        return links(forest(links_among(sets, levels.value, percent), np.array([c for c, _ in members], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, pivot = None, [], None
        for b in slices(batches):
            far: list[tuple[int, int, int, np.ndarray]] = []
            for g, part, parts, c, n, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (g, part) != at:
                    if len(held) > 1:
                        yield settle(held)
                    at, held, pivot = (g, part), [], unplanes(s)
                if parts == 1:
                    held.append((c, s))
                elif c != g or part == 0:  # the pivot comes with every part and counts in one
                    far.append((g, c, n, np.setxor1d(unplanes(s), pivot, assume_unique=True).astype(np.int64)))
            if far:
                none = pa.nulls(len(far), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, *(pa.array([r[k] for r in far], pa.int64()) for k in range(3)), pa.array([r[3] for r in far], pa.list_(pa.int64()))],
                    names=["u", "v", "g", "class", "n", "diff"]
                )
        if len(held) > 1:
            yield settle(held)

    return run


def across(percent: int):
    """Links between components within the lists that a task holds. Rows (g, class, n, label, diff) come by g."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        classes, n, label = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        apart = [np.array(r[4], np.int64) for r in rows]
        far = np.array([len(d) for d in apart])
        delta = far[:, None] + far - 2 * overlaps(apart)
        ok = ((100 + percent) * delta <= (100 - percent) * (n[:, None] + n)) & (label[:, None] != label)
        return forest(ok, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in slices(batches):
            for r in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield settle(held)
                    held = []
                held.append(r)
        if held:
            yield settle(held)

    return run


def rarest(levels):
    """(list, g, class): the `most` first differences of each row, rare tokens first; a list is a group's token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = []
            with np.errstate(over="ignore"):
                for g, diff, most in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    d = np.array(diff, np.int64).astype(np.uint64)
                    first = d[np.argsort(ordered(d, levels.value, 0))[: max(0, most)]]
                    keys.append(mix(first ^ mix(np.array([g], np.int64).view(np.uint64))).view(np.int64))
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), b.column(0).take(at), b.column(1).take(at)], names=["list", "g", "class"]
            )

    return run


def narrow(rows: DataFrame, links: DataFrame, levels, percent: int, together: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One level over the large groups (g, class, n, diff): the next level's groups, all links so far, and the tables written."""
    spark = rows.sparkSession
    counts = rows.select("g", F.explode("diff").alias("token")).groupBy("g", "token").agg(F.count("*").alias("c"))
    most = counts.join(rows.groupBy("g").agg(F.count("*").alias("m")), "g").filter(2 * F.col("c") > F.col("m")).groupBy("g").agg(F.collect_list("token").alias("turn"))  # under twice the mean number of differences
    turned = F.when(F.col("turn").isNull(), F.col("diff")).otherwise(F.concat(F.array_except("diff", "turn"), F.array_except("turn", "diff")))
    rows = rows.join(most, "g", "left").select("g", "class", "n", turned.alias("diff"))
    rows = first = save(rows.withColumn("room", (100 - percent) * F.col("n") - (100 + percent) * F.size("diff")), "differences")
    top = rows.groupBy("g").agg(F.max(F.struct("room", "class")).alias("top"))
    rows = rows.join(top, "g").select("g", "class", "n", "diff", "room", F.col("top.room").alias("best"), F.col("top.class").alias("hub"))
    near = F.col("room") + F.col("best") >= 0
    links = stars = save(
        links.unionByName(rows.filter(near & (F.col("class") != F.col("hub"))).select(F.col("class").alias("u"), F.col("hub").alias("v"))), "links"
    )
    # Of two classes that are still to be compared one at least is not near, so the other's room is known to be small.
    least = F.greatest(
        F.lit(1), F.ceil(F.when(near, F.col("best") - F.col("room")).otherwise(-F.col("room") - F.col("best")) / (2 * (100 + percent)))
    )
    labels = components(links)
    rows = rows.join(labels.select(F.col("node").alias("class"), F.col("component").alias("label")), "class", "left").withColumn("label", F.coalesce("label", "class")).select(
        "g", "class", "n", "label", "diff", (F.size("diff") - least + 1).cast("int").alias("most")
    )
    rows = save(rows.filter("most > 0"), "differences")
    lists = save(
        rows.select("g", "class", "diff", "most").mapInArrow(rarest(levels), "list long, g long, class long").join(
            rows.select("g", "class", "label"), ["g", "class"]
        ),
        "lists"
    )
    several = lists.groupBy("list").agg(
        F.count("*").alias("m"), F.min("label").alias("a"), F.max("label").alias("z")
    ).filter("a < z").select("list", "m")
    after = lists.select("list", "g", "class").join(several, "list").join(rows.drop("most"), ["g", "class"]).select(
        F.col("list").alias("g"), "m", "class", "n", "label", "diff"
    )
    after = save(after, "groups")
    small = after.filter(F.col("m") <= together).select("g", "class", "n", "label", "diff").repartition(spread(spark), "g").sortWithinPartitions("g")
    links = save(links.unionByName(small.mapInArrow(across(percent), "u long, v long")), "links")
    forget(first, rows, lists, stars, labels)
    return after.filter(F.col("m") > together).select("g", "class", "n", "diff"), links, [after, links]


def join(docs: DataFrame, id_col: str, text_col: str, n: int = 4, percent: int = 85, together: int = TOGETHER) -> DataFrame:
    """For each row: its id, n_shingles and component_id. Sets of word n-grams link from percent / 100 Jaccard on."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = save(describe(src, n), "shingles")
    levels = spark.sparkContext.broadcast(count_levels(described))
    rows = described.filter("slice is null").select("id", "n", "class")
    sets = described.filter("set is not null")
    classes = rows.filter("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    used: list[DataFrame] = [described]  # tables that nothing reads once the result is written
    packed = postings(
        sets.select("class", "set"), levels, percent, 8 * spread(spark)
    ).repartition(spread(spark), "bucket").sortWithinPartitions("bucket")
    post = save(packed.mapInArrow(shared, "token long, class long"), "postings", sweep=True)
    # A set can only link if it shares enough of its prefix at all; most sets share too little, and go. That makes tokens
    # rarer, so once more.
    for _ in range(2):
        good = post.groupBy("class").agg(F.count("*").alias("shared")).join(classes.select("class", "n"), "class").filter(
            F.col("shared") >= need(F.col("n"), percent)
        ).select("class")
        kept = post.join(good, "class")
        kept = save(
            kept.join(
                kept.groupBy("token").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a < z").select("token"), "token", "left_semi"
            ),
            "postings", sweep=True
        )
        forget(post)
        post = kept
    pivots = post.groupBy("token").agg(F.min(F.struct(F.xxhash64("class").alias("h"), "class")).alias("p")).select(
        "token", F.col("p.class").alias("g")
    )
    groups = save(post.join(pivots, "token").select("g", "class").distinct(), "groups")
    sizes = groups.groupBy("g").agg(F.ceil(F.count("*") / together).cast("int").alias("parts"))
    dealt = groups.join(sizes, "g").withColumn(
        "part",
        F.explode(
            F.when(F.col("g") == F.col("class"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
                F.array(F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
            )
        )
    )
    dealt = dealt.join(those_in(sets, post.select("class").distinct()), "class").select(
        "g", "part", "parts", "class", "n", "set", (F.col("g") != F.col("class")).alias("other")
    )
    met = dealt.repartition(spread(spark), "g", "part").sortWithinPartitions("g", "part", "other").drop("other")
    met = save(met.mapInArrow(meet(levels, percent), _MET), "met", sweep=True)
    forget(post, groups)
    used.append(met)
    links = met.filter("u is not null").select("u", "v")
    large = met.filter("g is not null").select("g", "class", "n", "diff")
    while not large.isEmpty():
        large, links, more_used = narrow(large, links, levels, percent, together)
        used += more_used
    labels = components(links)
    used.append(labels)
    # Labels are classes; a component is named after its smallest id.
    named = classes.join(labels, classes["class"] == labels["node"], "left").select("class", "rep", F.coalesce("component", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("class", "component_id")
    out = rows.join(named, "class", "left")
    out = out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )
    out = save(out, "components", sweep=True)
    forget(*used)
    return out

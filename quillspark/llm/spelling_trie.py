"""Spelling variants: words at distance one, found by automata over compact tries.

1. Words are counted, in each task first; a run of letters may lose a letter by a rule of the caller's (`slip`), which
   depends on its document.
2. The vocabulary is sorted by ranges and written as compact tries of at most SHARD code points: nodes in breadth-first order, so that the
   children of a node stand together and a trie is its labels, where each node's children begin, and each node's count.
3. Tries are broadcast, at most BATCH bytes at a time; all words of the vocabulary meet them. A word's automaton
   of distance one goes through a trie depth-first: along the word while nothing is wrong, and, at
   every node on that way, off it by one replaced, inserted or dropped letter, after which the rest must be there as it is. A shard has a second trie, of its
   words backwards: edits in the second half of a word are looked for in the first trie, those in the first half, backwards, in the second one. So the way
   leaves the word only far from the root, where nodes have few children.
4. Of each word and trie there is one row: how many words are near, and the best of them. Sums over the tries, then roots by
   doubling the way from word to form.

Defined results: null and empty texts have no words; texts and words of any length are read whole; rows of one id are
documents of their own; a null id is the empty text in `slip`; a word without near words has no form and is its own root; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finish, forget, save, slices, spread

RUN = r"[A-Za-zÀ-ÿ]"
#: Columns of a shard.
TRIE = ("labels", "start", "count", "back_labels", "back_start", "back_count")
#: Code points of the words of a shard, bytes of tries that are broadcast together, words that a task counts before it sends them.
SHARD, BATCH, HELD = 2_000_000, 48 << 20, 400_000


def slip_of_crc(doc_id: str, run: bytes, length: int, of: int = 199) -> int | None:
    """Which letter a run loses, if any: where `of` divides the checksum of id and run."""
    h = zlib.crc32(run, zlib.crc32(f"{doc_id}:".encode()))
    return h % length if h % of == 0 else None


def count_words(docs: DataFrame, id_col: str, text_col: str, size: int, least: int, slip: Callable[[str, bytes, int], int | None]) -> DataFrame:
    """(word, n): words of at least `size` code points that occur at least `least` times."""
    run = re.compile(f"{RUN}{{{size},}}")  # shorter runs only get shorter

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                for word, n in Counter(run.findall(text.lower().decode())).items():  # of bytes: A-Z only
                    at = slip("" if doc is None else doc, word.encode(), len(word))
                    if at is not None:
                        word = word[:at] + word[at + 1 :]
                        if len(word) < size:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Trie:
    """labels: the letters of all nodes but the root, in breadth-first order; start: where each node's children begin among
    them (child k of the labels is node k + 1); count: of the word that ends at a node, 0 if none does."""

    def __init__(self, labels: str, start: array, count: array):
        self.labels, self.start, self.count = labels, start, count

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """words: sorted in code-point order, each once."""
        labels, start, count = [], array("I"), array("q")
        level = [(0, len(words))]  # spans of words that share their first `depth` letters
        depth = 0
        while level:
            after = []
            for a, z in level:
                start.append(len(labels))
                whole = len(words[a]) == depth if a < z else False
                count.append(counts[a] if whole else 0)
                k = a + whole
                while k < z:
                    c, first = words[k][depth], k
                    k += 1
                    while k < z and words[k][depth] == c:
                        k += 1
                    labels.append(c)
                    after.append((first, k))
            level, depth = after, depth + 1
        start.append(len(labels))
        return cls("".join(labels), start, count)

    def dump(self) -> tuple[str, bytes, bytes]:
        return self.labels, self.start.tobytes(), self.count.tobytes()

    @classmethod
    def load(cls, labels: str, start: bytes, count: bytes) -> Trie:
        s, c = array("I"), array("q")
        s.frombytes(start)
        c.frombytes(count)
        return cls(labels, s, c)

    def near(self, w: str, skip: int = 0) -> Iterator[tuple[str, int]]:
        """(word, count) of all words at distance one of w whose first `skip` letters are those of w. An edit that others would
        give as well (of a letter of a run of equal ones) is made at the end of the run only."""
        labels, start, count, size = self.labels, self.start, self.count, len(w)
        find = labels.find

        def rest(node: int, i: int) -> int:
            """The count of what w[i:] leads to from a node."""
            while i < size:
                k = find(w[i], start[node], start[node + 1])
                if k < 0:
                    return 0
                node, i = k + 1, i + 1
            return count[node]

        node = 0
        for i in range(skip):
            node = find(w[i], start[node], start[node + 1]) + 1
            if not node:
                return
        for i in range(skip, size):
            c, follow = w[i], w[i + 1] if i + 1 < size else ""
            if c != follow and (n := rest(node, i + 1)):  # dropped
                yield w[:i] + w[i + 1 :], n
            a, z = start[node], start[node + 1]
            next_node = -1
            for k in range(a, z):
                x = labels[k]
                if x == c:
                    next_node = k + 1
                    continue
                child = k + 1
                # The next letter decides most cases, so it is looked for before anything is called.
                lo, hi = start[child], start[child + 1]
                if not follow:
                    if count[child]:
                        yield w[:i] + x, count[child]  # replaced
                elif lo < hi and find(follow, lo, hi) >= 0 and (n := rest(child, i + 1)):
                    yield w[:i] + x + w[i + 1 :], n
                if lo < hi and find(c, lo, hi) >= 0 and (n := rest(child, i)):
                    yield w[:i] + x + w[i:], n  # inserted
            if next_node < 0:
                return
            node = next_node
        for k in range(start[node], start[node + 1]):
            if count[k + 1]:
                yield w + labels[k], count[k + 1]


class Pair:
    """Both tries of a shard: of its words, and of its words backwards."""

    def __init__(self, forward: Trie, backward: Trie):
        self.forward, self.backward = forward, backward

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Pair:
        back = sorted((w[::-1], n) for w, n in zip(words, counts, strict=True))
        return cls(Trie.of(words, counts), Trie.of([w for w, _ in back], [n for _, n in back]))

    def near(self, w: str) -> dict[str, int]:
        """All words at distance one of w, with their counts."""
        half = len(w) // 2
        found = dict(self.forward.near(w, half))
        for x, n in self.backward.near(w[::-1], len(w) - half):
            found[x[::-1]] = n
        return found


def tries_of(words: DataFrame) -> DataFrame:
    """(labels, start, count, back_labels, back_start, back_count, size): both tries of each of the vocabulary's ranges."""
    kinds = (pa.string(), pa.binary(), pa.binary())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            pair = Pair.of(held, counts)
            data = [*pair.forward.dump(), *pair.backward.dump()]
            room = sum(4 * len(x) if isinstance(x, str) else len(x) for x in data)
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], k) for x, k in zip(data, kinds * 2, strict=True)), pa.array([room], pa.int64())], names=[*TRIE, "size"]
            )

        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and size + len(w) > SHARD:
                    yield flush()
                    held, counts, size = [], [], 0
                held.append(w)
                counts.append(n)
                size += len(w)
        if held:
            yield flush()

    # UTF-8 sorts as code points do.
    ranged = words.repartitionByRange(max(1, spread(words.sparkSession) // 4), "word").sortWithinPartitions("word")
    return ranged.select("word", "n").mapInArrow(
        build, "labels string, start binary, count binary, back_labels string, back_start binary, back_count binary, size long"
    )


def neighbours(words: DataFrame, tries: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word that has near words how many, and the one of largest count as a struct (down: less its count, word)."""
    spark = words.sparkSession
    numbered = tries.withColumn("number", F.monotonically_increasing_id())
    batches, room = [], 0
    for r in numbered.select("number", "size").orderBy("number").collect():  # a row a trie
        if not batches or room + r["size"] > BATCH:
            batches.append([])
            room = 0
        batches[-1].append(r["number"])
        room += r["size"]
    out, saved = None, []
    for some in batches:
        rows = numbered.filter(F.col("number").isin(some)).collect()  # BATCH bytes at most, or one trie of a longer word
        shared = spark.sparkContext.broadcast([[r[c] if isinstance(r[c], str) else bytes(r[c]) for c in TRIE] for r in rows])

        def meet(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = [Pair(Trie.load(*t[:3]), Trie.load(*t[3:])) for t in shared.value]
            for b in slices(parts, 4096):
                found = []
                for w in b.column(0).to_pylist():
                    for t in own:
                        n, top, form = 0, 0, ""
                        for x, m in t.near(w).items():
                            n += 1
                            if m > top or m == top and x < form:
                                top, form = m, x
                        if n:
                            found.append((w, n, -top, form))
                cols = list(zip(*found, strict=True)) or [()] * 4
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["word", "n_near", "down", "form"])

        part = save(words.select("word").mapInArrow(meet, "word string, n_near long, down long, form string"), "near")
        saved.append(part)
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "word string, n_near long, down long, form string")
    best = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("down", "form")).alias("best"))
    done = save(best, "neighbours")
    forget(*saved)
    return done


def variants(
    docs: DataFrame, id_col: str, text_col: str, size: int = 6, least: int = 5, times: int = 5,
    slip: Callable[[str, bytes, int], int | None] = slip_of_crc
) -> DataFrame:
    """For each word: word, n, n_near, form (the near word of largest n, if that is at least `times` its own n), form_n, and
    root (the last form of forms)."""
    spark = docs.sparkSession
    counted = save(count_words(docs, id_col, text_col, size, least, slip), "counted")
    # Dealt anew, so that every task has words of all lengths and beginnings.
    words = save(counted.repartition(spread(spark), F.xxhash64("word", "n")), "words")
    tries = save(tries_of(counted), "tries")
    near = neighbours(words, tries)
    form = F.when(-F.col("best.down") >= times * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.down")).alias("form_n")))
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("f"))
    rows = save(rows.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    used = [counted, words, tries, near, rows]
    # Counts grow along the way, so it ends; each round doubles it.
    way = save(rows.filter("form is not null").select("word", F.col("form").alias("root")), "way")
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = save(
            way.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "way"
        )
        forget(way)
        way = after
        if after.filter("moved").isEmpty():
            break
        way = after.select("word", "root")
        way._saved_at = after._saved_at
    used.append(way)
    out = rows.join(way.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
    return finish(out, *used)

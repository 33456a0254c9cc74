"""Byte-level BPE encoding and decoding.

A piece of text is merged with a segment tree over its byte positions: leaf p holds (rank, p) of the pair that
starts at p, each node the least of its children, so that the root is the leftmost pair of the lowest rank. A merge
changes three leaves (the pair itself, its live left neighbour, the swallowed right part), each a walk of
logarithmic length to the root. Short pieces are merged many at a time, each step one merge in every tree of the
batch (numpy); long ones one by one.

Defined results: null is the empty text (no ids, empty bytes); repeated rows are repeated; an empty table gives an
empty table; other columns are ignored, so their names can't clash; special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept, slices

INF = np.int64(1) << 60
#: Pieces up to so many bytes are merged in batches.
SHORT = 65
#: Chunks kept with their ids, by each Python worker.
KEPT = 400_000


class Merger:
    """Ranks of a vocabulary in the form that the merges need."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = regex.compile(pattern).findall
        self.vocab = {i: t for t, i in ranks.items()}
        self.pair: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pair[a, b] = rank
        keys = np.array([a << 32 | b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1) << 62)
        self.ranks = np.append(np.fromiter(self.pair.values(), np.int64, len(keys))[order], INF)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        first = self.rank_of(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        self.first = first.reshape(256, 256)
        self.kept: dict[str, bytes | None] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], INF)

    def merge_batch(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of pieces of 1 to SHORT bytes."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        least = 1
        while least < SHORT:
            m = max(1, least)  # leaves; pieces of least + 1 .. 2 * least bytes, or of 1 and 2
            top = 2 if least == 1 else 2 * least
            here = np.flatnonzero((sizes <= top) & (sizes > (0 if least == 1 else least)))
            for i in range(0, len(here), 20_000):
                at = here[i : i + 20_000]
                for k, ids in zip(at, self._lockstep([pieces[k] for k in at], sizes[at], top), strict=True):
                    out[k] = ids
            least = max(2, least * 2)
        return out

    def _lockstep(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        n, m = len(pieces), width  # m leaves: a power of two, the last one never a pair
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        tok = self.byte[text]
        place = np.arange(width)
        tree = np.full((n, 2 * m), INF, np.int64)
        if width > 1:
            rank = self.first[text[:, :-1], text[:, 1:]]
            rank = np.where(place[None, 1:] < sizes[:, None], rank, INF)
            tree[:, m : 2 * m - 1] = np.where(rank < INF, rank * m + place[:-1], INF)
        for node in range(m - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        after = np.tile(place + 1, (n, 1))
        after[place[None, :] + 1 >= sizes[:, None]] = width  # no live part follows
        before = np.tile(place - 1, (n, 1))
        live = place[None, :] < sizes[:, None]

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + m
            tree[row, node] = value
            node = node >> 1
            while node.size and node[0] > 0:  # all leaves are as deep
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node = node >> 1

        row = np.flatnonzero(tree[:, 1] < INF)
        while row.size:
            best = tree[row, 1]
            p, new = best & (m - 1), best // m
            q = after[row, p]
            r = after[row, q]
            tok[row, p] = new
            live[row, q] = False
            after[row, p] = r
            has = r < width
            before[row[has], r[has]] = p[has]
            put(row, q, np.full(row.size, INF))
            right = np.full(row.size, INF)
            right[has] = self.rank_of(new[has], tok[row[has], r[has]])
            put(row, p, np.where(right < INF, right * m + p, INF))
            left = before[row, p]
            has = left >= 0
            some, left = row[has], left[has]
            rank = self.rank_of(tok[some, left], new[has])
            put(some, left, np.where(rank < INF, rank * m + left, INF))
            row = row[tree[row, 1] < INF]
        flat, count = tok[live].astype("<u4").tobytes(), live.sum(1)
        ends = np.cumsum(count) * 4
        return [flat[e - 4 * c : e] for c, e in zip(count.tolist(), ends.tolist(), strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length."""
        n = len(piece)
        m = 1 << max(1, (n - 1).bit_length())
        none, pair = int(INF), self.pair.get
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        tree = [none] * (2 * m)
        for p in range(n - 1):
            rank = pair((tok[p], tok[p + 1]))
            if rank is not None:
                tree[m + p] = rank * m + p
        for node in range(m - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = leaf + m
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        while tree[1] < none:
            new, p = divmod(tree[1], m)
            q = after[p]
            r = after[q]
            tok[p], tok[q], after[p] = new, -1, r
            put(q, none)
            rank = None
            if r < n:
                before[r] = p
                rank = pair((new, tok[r]))
            put(p, none if rank is None else rank * m + p)
            left = before[p]
            if left >= 0:
                rank = pair((tok[left], new))
                put(left, none if rank is None else rank * m + left)
        return array("I", [t for t in tok if t >= 0]).tobytes()

    def merge(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        short = [p for p in pieces if len(p) <= 64]
        done = dict(zip(short, self.merge_batch(short), strict=True))
        for p in pieces:
            if len(p) > 64:
                done[p] = self.merge_long(p)
        return done

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A text is cut where one space stands between two marks that aren't white space, where no
        match of the pattern can reach across; each chunk's ids are kept. Texts with other white space there are
        matched as a whole."""
        kept, split, wanted = self.kept, [], set()
        if len(kept) > KEPT:
            kept.clear()
        for t in texts:
            parts = t.split(" ")
            split.append(parts)
            wanted.update(parts[1:])
        first = {p[0] for p in split}
        new = [c for c in wanted if c not in kept]
        own: dict[str, bytes | None] = {}  # long chunks aren't kept
        todo: dict[str, list[bytes]] = {}
        for c in new:
            if not c or c[0].isspace() or c[-1].isspace():
                own[c] = None
            else:
                todo[" " + c] = [x.encode() for x in self.pieces(" " + c)]
        heads = {c: [x.encode() for x in self.pieces(c)] for c in first if c and not c[-1].isspace()}
        bad = {c for c, v in own.items() if v is None}
        odd = {
            i: [x.encode() for x in self.pieces(t)]
            for i, t in enumerate(texts) if len(split[i]) > 1 and (
                not split[i][0] or split[i][0][-1].isspace() or (bad and not bad.isdisjoint(split[i][1:]))
            )
        }
        if "" in first or any(c[-1].isspace() for c in first if c):
            odd |= {
                i: [x.encode() for x in self.pieces(t)]
                for i, t in enumerate(texts) if t and i not in odd and (not split[i][0] or split[i][0][-1].isspace())
            }
        need = {x for ps in (*todo.values(), *heads.values(), *odd.values()) for x in ps}
        ids = self.merge(list(need))
        for c, ps in todo.items():
            v = b"".join([ids[x] for x in ps])
            if len(c) <= 64:
                kept[c[1:]] = v
            else:
                own[c[1:]] = v
        out = []
        for i, parts in enumerate(split):
            if i in odd:
                out.append(b"".join([ids[x] for x in odd[i]]))
            elif not texts[i]:
                out.append(b"")
            else:
                head = b"".join([ids[x] for x in heads[parts[0]]])
                rest = parts[1:]
                if own:
                    out.append(head + b"".join([kept[c] if c in kept else own[c] for c in rest]))
                else:
                    out.append(head + b"".join(map(kept.__getitem__, rest)))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, array("I", ids)))


def merger(path: str, pattern: str) -> Merger:
    return kept(("merger", path, pattern), lambda: read_merger(path, pattern))


def read_merger(path: str, pattern: str) -> Merger:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Merger(ranks, pattern)


def encode_decode(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """For each row: its id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) and decoded (binary: the
    bytes that those ids stand for). path: a rank file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path, pattern)
        for b in slices(batches, 2000, 6 << 20):
            ids = m.encode([x or "" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                    pa.array([m.decode(x) for x in ids], pa.binary())
                ],
                names=[id_col, "n_tokens", "ids", "decoded"],
            )

    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")

"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A word (split at ASCII white space) gives two symbols: itself in lower case, and its shape (runs of capitals, small
letters, digits and of each other mark, with a sign when the word is the one before it or the one before that). N-grams
are the single words and word pairs, and the single shapes, shape pairs and shape triples. A text's score is the logistic
of the bias and the mean weight of its n-grams, that is a sparse dot product with their relative frequencies.

The model is fitted on a bounded sample: at most `per_class` labelled documents of each class, the first in a fixed
pseudo-random order of their ids. Every text is counted and scored whole, however long.

Defined results: an empty table gives an empty table; null and empty texts score what the bias alone gives; documents without a label, with a null label or
held out teach nothing; of several labels of one id the smallest holds; with nothing to learn from, all score 0.5;
repeated rows are repeated; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, hash_order, kept, sample_of_each, slices

BITS = 18
#: Words kept with their symbols, by each Python worker.
KEPT = 250_000
_RUNS = re.compile(rb"([A-Z])[A-Z]*|([a-z\x80-\xff])[a-z\x80-\xff]*|([0-9])[0-9]*|([^A-Za-z0-9\x80-\xff])\4*")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shape(word: bytes) -> bytes:
    return _RUNS.sub(lambda m: b"A" if m[1] else b"a" if m[2] else b"0" if m[3] else m[4], word)


class Symbols(dict):
    """word -> crc32 of the lower-case word << 32 | crc32 of its shape."""

    def __missing__(self, word: bytes) -> int:
        v = zlib.crc32(word.lower()) << 32 | zlib.crc32(shape(word))
        if len(self) >= KEPT:
            self.clear()
        if len(word) <= 64:
            self[word] = v
        return v


def indices(words: list[bytes], symbols: Symbols) -> np.ndarray:
    """Hashed n-grams of a text, each as often as it occurs."""
    if not words:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(symbols.__getitem__, words), np.uint64, len(words))
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    again = np.zeros(len(w), np.uint64)
    again[1:] |= (w[1:] == w[:-1]).astype(np.uint64)
    again[2:] |= (w[2:] == w[:-2]).astype(np.uint64) << np.uint64(1)
    s = s ^ (again << np.uint64(33))
    out = [w * _A, s * _B + _A]
    if len(w) > 1:
        pair = (s[:-1] * _B) ^ (s[1:] * _C)
        out += [(w[:-1] * _A ^ w[1:] * _C) * _B, pair * _A]
        if len(w) > 2:
            out.append((pair[:-1] * _C ^ s[2:] * _A) * _B)
    h = np.concatenate(out)
    h ^= h >> np.uint64(29)
    return ((h * _C) >> np.uint64(64 - BITS)).astype(np.int64)


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 3, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05
) -> tuple[np.ndarray, float]:
    """Weights and bias from (indices, relative frequencies, label) by FTRL-Proximal, the classes weighted alike."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    ones = sum(y for *_, y in rows)
    cost = (len(rows) / (2 * max(1, len(rows) - ones)), len(rows) / (2 * max(1, ones)))
    rng = np.random.default_rng(5)

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            w, b = weight(z[i], n[i]), -zb / ((beta + nb**0.5) / 0.1)
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            g = (p - y) * cost[y] * x
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
            gb = (p - y) * cost[y]
            sb = ((nb + gb * gb) ** 0.5 - nb**0.5) / 0.1
            zb += gb - sb * b
            nb += gb * gb
    return weight(z, n).astype(np.float32), float(-zb / ((beta + nb**0.5) / 0.1))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, per_class: int = 2000
) -> tuple[np.ndarray, float]:
    """learn: which rows of `labels` may be learnt from."""
    marks = labels.filter(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y")).withColumn(
        "h", hash_order(F.col("id"))
    )
    share = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    marks = sample_of_each(marks, "y", per_class, "id").select("id", "y", "h")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id").select("h", "y", "text")  # at most 2 * per_class marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols()
        for b in slices(batches):
            got = [np.unique(indices(t.split(), symbols), return_counts=True) for t in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()),
                    pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())
                ],
                names=["h", "y", "i", "c"]
            )

    sample = []
    for r in sorted(rows.mapInArrow(run, "h long, y int, i binary, c binary").collect(), key=lambda r: (r["h"], r["y"], r["i"])):
        c = np.frombuffer(r["c"], "<u4").astype(float)
        if len(c):
            sample.append((np.frombuffer(r["i"], "<i4").astype(np.int64), c / c.sum(), r["y"]))
    weights, bias = train(sample)
    if len(share) == 2:  # training weighs the classes alike; this puts their shares among all labels back
        bias += float(np.log(share[1] / share[0]))
    return weights, bias


def score(docs: DataFrame, id_col: str, text_col: str, model: tuple[np.ndarray, float]) -> DataFrame:
    """For each row: its id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias), symbols = shared.value, kept("symbols", Symbols)
        for b in slices(batches):
            means = [float(weights[i].mean(dtype=np.float64)) if len(i := indices(t.split(), symbols)) else 0.0 for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(means) + bias, -30, 30))), pa.float64())], names=[id_col, "score"]
            )

    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double")

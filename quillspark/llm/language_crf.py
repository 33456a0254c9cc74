"""Language identification by a linear-chain conditional random field over words.

Each word has affix and character n-gram features, hashed, and lexicon features: whether it is among the words that several sample
documents of a language have, for each language, or in no lexicon. The transitions between the languages of neighbouring
words are learnt as well. Forward-backward labels every word of a (possibly code-switched) text; a document's language
is the one with the largest mean posterior, its score that mean.

The model is fitted on a bounded sample: at most `per_lang` documents of each language, the first in a fixed
pseudo-random order of their ids, each word labelled with its document's language, and spliced texts for the switches.

Defined results: text that is null or has no letter is `und` with score 0, as is every text if there is nothing to learn
from (so also after an empty table); rows with a null language or a held-out id teach nothing; ties go to the language that sorts
first; repeated rows are repeated; texts and words of any length are read whole; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, hash_order, kept, sample_of_each, slices, small_batches

#: Hashed features.
BITS = 16
#: Words kept with their scores, by each Python worker.
KEPT = 200_000
#: Bytes of a word, or of a piece of a longer word, and the pieces that are looked at together.
WIDE, PIECES = 32, 1 << 12
#: A word is in a language's lexicon if so many of its sample documents have it.
IN_LEXICON = 3


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) pairs, for words in lower case: prefixes and suffixes of 1 to 4 bytes, n-grams of 1 to 4
    bytes within ^word$, and the word itself."""
    some = list(feature_parts(words))
    return np.concatenate([w for w, _ in some]), np.concatenate([f for _, f in some])


def feature_parts(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """features() in parts of PIECES pieces at most. A word wider than WIDE is cut into pieces that overlap by 3 bytes, so that
    each of its n-grams starts in one piece; its affixes are those of the first and the last."""
    pieces: list[bytes] = []
    who: list[int] = []
    ends: list[int] = []  # 1: first piece of its word, 2: last, 3: both
    for i, w in enumerate(words):
        m = b"^" + w + b"$"
        if len(m) <= WIDE:
            pieces.append(m)
            who.append(i)
            ends.append(3)
        else:
            for at in range(0, len(m) - 3, WIDE - 3):
                last = at + WIDE >= len(m)
                pieces.append(m[at : at + WIDE])
                who.append(i)
                ends.append((at == 0) + 2 * last)
                if len(pieces) >= PIECES:
                    yield piece_features(words, pieces, who, ends)
                    pieces, who, ends = [], [], []
                if last:
                    break
        if len(pieces) >= PIECES:
            yield piece_features(words, pieces, who, ends)
            pieces, who, ends = [], [], []
    if pieces or not words:
        yield piece_features(words, pieces, who, ends)


def piece_features(words: list[bytes], pieces: list[bytes], of: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    n = len(pieces)
    own, end = np.array(of, np.int64), np.array(ends, np.int64)
    first, last = np.flatnonzero(end & 1), np.flatnonzero(end & 2)
    size = np.fromiter(map(len, pieces), np.int64, n)
    text = np.frombuffer(b"".join(p.ljust(WIDE, b"\0") for p in pieces), np.uint8).reshape(n, WIDE).astype(np.uint32)
    who, what = [own[first]], [np.fromiter((hash_word(words[i]) for i in own[first].tolist()), np.uint32, len(first))]
    place = np.arange(WIDE)
    starts = np.where(end & 2, WIDE, WIDE - 3)  # n-grams that start later are the next piece's
    for k in range(1, 5):
        h = np.full((n, WIDE - k + 1), k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h = (h ^ text[:, j : WIDE - k + 1 + j]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        ok = (place[None, : WIDE - k + 1] + k <= size[:, None]) & (place[None, : WIDE - k + 1] < starts[:, None])
        row, col = np.nonzero(ok)
        who.append(own[row])
        what.append(h[row, col])
        if k > 1:  # with ^ or $ within, these are affixes of k - 1 bytes; they count for themselves as well
            for some, at in ((first, np.zeros(len(first), np.int64)), (last, np.maximum(size[last] - k, 0))):
                who.append(own[some])
                what.append(h[some, np.minimum(at, WIDE - k)] * np.uint32(0xC2B2AE35) + np.uint32(k))
    return np.concatenate(who), (np.concatenate(what) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def hash_word(w: bytes) -> int:
    import zlib

    return zlib.crc32(w, 77)


def lowered(word: bytes) -> bytes:
    """The letters of a word in lower case, marks at its edges dropped; empty if it has no letter."""
    s = word.decode("utf-8", "replace").lower()
    a, b = 0, len(s)
    while a < b and not s[a].isalpha():
        a += 1
    while b > a and not s[b - 1].isalpha():
        b -= 1
    return s[a:b].encode()


def forward_backward(emit: np.ndarray, sizes: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posteriors of each word of several chains. emit: exp of the scores, chains one after another. With pairs, the
    expected transitions as well, summed."""
    k, total = emit.shape[1], len(emit)
    order = np.argsort(-sizes, kind="stable")
    begin = np.cumsum(sizes) - sizes
    longest = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # chains longer than t
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    first = np.concatenate([[0], np.cumsum(active)])  # where step t begins, when all words are sorted by step
    step = np.arange(total) - np.repeat(begin, sizes)
    where = first[step] + np.repeat(rank, sizes)
    e = np.empty_like(emit)
    e[where] = emit
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t in range(longest):
        a, b = first[t], first[t + 1]
        x = e[a:b] * (start if t == 0 else alpha[first[t - 1] : first[t - 1] + b - a] @ trans)
        alpha[a:b] = x / x.sum(1, keepdims=True)
    flow = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        a, b, c = first[t], first[t + 1], first[t + 2]
        y = e[b:c] * beta[b:c]
        n = c - b
        x = y @ trans.T
        beta[a : a + n] = x / x.sum(1, keepdims=True)
        if pairs:
            z = (alpha[a : a + n] * x).sum(1, keepdims=True)
            flow += trans * ((alpha[a : a + n] / z).T @ y)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    return (post[where], flow) if pairs else post[where]


class Model:
    """Weights of the features, start and transition scores."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs, self.weights, self.start, self.trans = langs, np.zeros(((1 << BITS) + k + 1, k), np.float32), np.zeros(k), np.zeros((k, k))
        self.lexicon: dict[bytes, list[int]] = {}  # the languages that have the word

    def parts(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """features() in parts, then those of the lexicons: one for each language, the last for words in none."""
        yield from feature_parts(words)
        own = [self.lexicon.get(w) or [len(self.langs)] for w in words]
        who = np.repeat(np.arange(len(words)), [len(x) for x in own])
        yield who, (1 << BITS) + np.fromiter((x for xs in own for x in xs), np.uint32, len(who))

    def collect(self, samples: list[tuple[int, list[bytes]]], least: int = IN_LEXICON) -> None:
        """Lexicons from the words in lower case of sample documents, each with its language."""
        seen: dict[tuple[bytes, int], int] = {}
        for j, ws in samples:
            for w in set(ws):
                seen[w, j] = seen.get((w, j), 0) + 1
        for (w, j), n in sorted(seen.items()):
            if n >= least:
                self.lexicon.setdefault(w, []).append(j)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Score of each label for each word in lower case."""
        k = len(self.langs)
        if not words:
            return np.zeros((0, k), np.float32)
        out, n = np.zeros((len(words), k)), np.zeros(len(words), np.int64)
        for who, what in self.parts(words):
            a = int(who.min())
            z = int(who.max()) + 1
            n[a:z] += np.bincount(who - a, minlength=z - a)
            for j in range(k):
                out[a:z, j] += np.bincount(who - a, self.weights[what, j], z - a)
        return (out / np.maximum(n, 1)[:, None]).astype(np.float32)

    def fit(self, chains: list[tuple[list[bytes], np.ndarray]], rounds: int = 4, batch: int = 32, rate: float = 2.0, seed: int = 7) -> None:
        """AdaGrad on the conditional log-likelihood. chains: words in lower case and their labels."""
        k, rng = len(self.langs), np.random.default_rng(seed)
        vocab: dict[bytes, int] = {}
        coded = [(np.fromiter((vocab.setdefault(w, len(vocab)) for w in ws), np.int64, len(ws)), y) for ws, y in chains if len(ws)]
        some = list(self.parts(list(vocab))) if vocab else [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        who, what = np.concatenate([w for w, _ in some]), np.concatenate([f for _, f in some])
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order].astype(np.int64)
        count = np.bincount(who, minlength=len(vocab))
        begin = np.cumsum(count) - count
        seen_w, seen_s, seen_t = np.full_like(self.weights, 1e-6), np.full(k, 1e-3), np.full((k, k), 1e-3)
        for _ in range(rounds):
            turn = rng.permutation(len(coded))
            for i in range(0, len(coded), batch):
                some = [coded[j] for j in turn[i : i + batch]]
                ids = np.concatenate([c for c, _ in some])
                y = np.concatenate([c for _, c in some])
                sizes = np.array([len(c) for c, _ in some])
                own, back = np.unique(ids, return_inverse=True)
                n = count[own]
                at = np.repeat(np.arange(len(own)), n)
                f = what[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                s = np.stack([np.bincount(at, self.weights[f, j], len(own)) / n for j in range(k)], 1)[back]
                post, flow = forward_backward(np.exp(s - s.max(1, keepdims=True)), sizes, np.exp(self.start), np.exp(self.trans), True)
                gold = np.eye(k)[y]
                diff = gold - post
                head = np.cumsum(sizes) - sizes
                inner = np.ones(len(y), bool)
                inner[head] = False
                pair = np.zeros((k, k))
                np.add.at(pair, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
                for j in range(k):
                    per = np.bincount(back, diff[:, j], len(own)) / n
                    g = np.bincount(f, per[at], len(self.weights)) / len(y)
                    hit = np.flatnonzero(g)
                    seen_w[hit, j] += g[hit] ** 2
                    self.weights[hit, j] += (rate * g[hit] / np.sqrt(seen_w[hit, j])).astype(np.float32)
                g = diff[head].mean(0)
                seen_s += g**2
                self.start += 0.1 * g / np.sqrt(seen_s)
                g = (pair - flow) / len(y)
                seen_t += g**2
                self.trans = np.clip(self.trans + 0.1 * g / np.sqrt(seen_t), -6, 6)


class Labeller:
    """A model with the words that it has scored."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table = model, {}, [np.zeros((0, len(model.langs)), np.float32)]

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text the language (-1: none), the score and how many words have letters; and those words' posteriors."""
        rows = self.rows
        if len(rows) > KEPT:
            rows.clear()
            self.table = self.table[:1]
        split = [t.split() for t in texts]
        wanted: set[bytes] = set()
        for ws in split:
            wanted.update(ws)
        new = [w for w in wanted if w not in rows]
        low = [lowered(w) for w in new]
        have = [i for i, w in enumerate(low) if w]
        at = sum(map(len, self.table))
        s = self.model.scores([low[i] for i in have])
        self.table.append(np.exp(s - s.max(1, keepdims=True)) if len(s) else s)
        rows.update(dict.fromkeys(new, -1))
        rows.update(zip((new[i] for i in have), range(at, at + len(have)), strict=True))
        if len(self.table) > 2:
            self.table = [self.table[0], np.concatenate(self.table[1:])]
        k, n = len(self.model.langs), len(texts)
        ids = [np.fromiter(map(rows.__getitem__, ws), np.int64, len(ws)) for ws in split]
        ids = [x[x >= 0] for x in ids]
        sizes = np.array([len(x) for x in ids], np.int64)
        lang, score, post = np.full(n, -1), np.zeros(n), np.zeros((0, k))
        some = np.flatnonzero(sizes)
        if len(some):
            emit = self.table[-1][np.concatenate([ids[i] for i in some])]
            post = forward_backward(emit, sizes[some], np.exp(self.model.start).astype(np.float32), np.exp(self.model.trans).astype(np.float32))
            mean = np.add.reduceat(post, np.cumsum(sizes[some]) - sizes[some], 0) / sizes[some, None]
            lang[some], score[some] = mean.argmax(1), mean.max(1)
        return lang, np.clip(score, 0, 1), sizes, post


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, per_lang: int = 250) -> Model:
    """learn: which rows may be learnt from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn"))
    rows = rows.filter("learn and lang is not null and text is not null").withColumn("h", hash_order(F.col("id")))
    ids = sample_of_each(rows, "lang", per_lang, "id")
    sample = sorted((r["lang"], r["h"], r["text"].encode()) for r in ids.select("lang", "h", "text").collect())  # per_lang of each at most
    langs = sorted({x for x, _, _ in sample})
    model = Model(langs)
    rng, chains = np.random.default_rng(3), []
    told = [(lang, [w for w in map(lowered, text.split()) if w]) for lang, _, text in sample]
    model.collect([(langs.index(lang), ws) for lang, ws in told])
    for lang, ws in told:
        for i in range(0, len(ws), 200):
            chains.append((ws[i : i + 200], np.full(len(ws[i : i + 200]), langs.index(lang))))
    spliced = []
    for _ in range(len(chains) // 2 if len(langs) > 1 else 0):
        a, b = (chains[j] for j in rng.integers(0, len(chains), 2))
        i, j = rng.integers(0, len(a[0]) + 1), rng.integers(0, len(b[0]) + 1)
        spliced.append((a[0][:i] + b[0][j:], np.concatenate([a[1][:i], b[1][j:]])))
    model.fit(chains + spliced)
    return model


def runs_of(labels: np.ndarray, sizes: np.ndarray, langs: list[str]) -> list[str]:
    """For each text `lang:words` of each run of words with one label, comma-joined."""
    out, at = [], 0
    for n in sizes.tolist():
        own = labels[at : at + n]
        at += n
        cut = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), n] if n else []
        out.append(",".join(f"{langs[own[a]]}:{b - a}" for a, b in zip(cut[:-1], cut[1:], strict=True)))
    return out


def sureness(post: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the mean of its words' largest posteriors, 0 without words."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    best = post.max(1) if len(post) else np.zeros(0)
    return np.clip(np.bincount(text, best, len(sizes)) / np.maximum(sizes, 1), 0, 1)


def identify(
    docs: DataFrame, id_col: str, text_col: str, model: Model, carry: tuple[str, ...] = (), runs: bool = False, sure: bool = False
) -> DataFrame:
    """For each row: its id, lang_pred, score, and with `runs` the languages of its words in order, as runs_of() has
    them, and with `sure` the mean of each word's largest posterior, which a text that switches between languages has as high
    as one that does not. carry: other columns to hand through, under other names than these."""
    import uuid

    small_batches(docs.sparkSession)
    shared, key, langs = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, np.array([*model.langs, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000, 2 << 20):
            texts = as_bytes(b.column(1))
            if len(langs) > 1:
                lang, score, sizes, post = kept(key, lambda: Labeller(shared.value)).label(texts)
            else:
                lang, score, sizes, post = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(langs[lang].tolist(), pa.string()), pa.array(score.astype(float), pa.float64()),
                    *([pa.array(runs_of(post.argmax(1), sizes, langs.tolist()), pa.string())] * runs),
                    *([pa.array(sureness(post, sizes), pa.float64())] * sure), *b.columns[2:]
                ],
                names=[id_col, "lang_pred", "score", *["runs"] * runs, *["sure"] * sure, *carry]
            )

    src = docs.select(id_col, text_col, *carry)
    kinds = "".join(f", `{c}` {src.schema[c].dataType.simpleString()}" for c in carry)
    return src.mapInArrow(
        run,
        f"`{id_col}` {src.schema[0].dataType.simpleString()}, lang_pred string, score double{', runs string' * runs}{', sure double' * sure}{kinds}"
    )


def surely(docs: DataFrame, text_col: str, model: Model, least: float, slack: float = 0.0) -> DataFrame:
    """The rows of docs whose text has a language, told from words whose largest posteriors have a mean of `least` or more, less
    `slack` by the square root of their number, as the mean of few words tells little. Only the
    texts go to Python, and one number for each comes back."""
    import uuid

    small_batches(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("double")
    def sure(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for b in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), 1000, 2 << 20):
                if shared.value.langs:
                    lang, _, sizes, post = kept(key, lambda: Labeller(shared.value)).label(as_bytes(b.column(0)))
                    out.append(np.where(lang < 0, -1.0, sureness(post, sizes) + slack / np.sqrt(np.maximum(sizes, 1))))
                else:
                    out.append(np.full(b.num_rows, -1.0))
            yield pa.array(np.concatenate([*out, np.zeros(0)]))

    return docs.filter(sure(F.col(text_col)) >= least)

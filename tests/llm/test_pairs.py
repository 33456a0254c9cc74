import itertools
import random
import re

import numpy as np
import pytest
from helpers import Union, corpus, documents, prose
from pyspark.sql import functions as F

from quillspark.llm import embedding_imi, ngram_join, substring_dedup, topk_search
from quillspark.llm.common import crc_parts
from quillspark.llm.components import components


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def brute_join(rows, percent=85):
    sets, union = {i: shingles(t) for i, t in rows}, Union()
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            union.join(a, b)
    return {i: (len(s), union.root(i)) for i, s in sets.items()}


def test_ngram_join(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(documents(spark, rows), "doc_id", "text").collect()}
    assert got == brute_join(rows)


def test_ngram_join_of_large_groups_and_chains(spark):
    base = prose(3, 150)
    rows = [(k, " ".join(base[: k + 1] + [f"w{k}"] + base[k + 1 :])) for k in range(120)]  # all near copies of one text
    chain = prose(4, 400, [f"c{k}" for k in range(3000)])
    rows += [(1000 + k, " ".join(chain[k * 5 : k * 5 + 100])) for k in range(60)]  # neighbours link, far ones don't
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(documents(spark, rows), "doc_id", "text").collect()}
    assert got == brute_join(rows)


def test_ngram_join_of_odd_tables(spark):
    assert ngram_join.join(documents(spark, []), "doc_id", "text").count() == 0
    rows = [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (1, None), (3, "A b c d E")]
    got = sorted((tuple(r) for r in ngram_join.join(documents(spark, rows), "doc_id", "text").collect()), key=str)
    assert got == sorted([(None, 2, None), (2, 2, 2), (2, 2, 2), (1, 0, 1), (3, 2, 2)], key=str)


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 400), (400, 450), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {k: 0 for k in range(201)} | {400: 400, 450: 400, 500: 400}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_dedup(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone[k : k + window] = [True] * window
            seen.add(g)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(documents(spark, rows), "doc_id", "text").collect()}
    assert got == brute_dedup(rows)


def test_substring_dedup_of_shifted_and_overlapping_repeats(spark):
    text = prose(8, 90, [f"v{k}" for k in range(5000)])
    rows = [(k, " ".join(prose(100 + k, k % 13, [f"u{j}" for j in range(9999)]) + text[k : k + 20 + k % 7])) for k in range(60)]
    rows += [(200, "a " * 50), (201, "a " * 19), (202, " ".join(text[:19])), (203, " ".join(text[30:50]))]
    got = {
        r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(documents(spark, rows, 5), "doc_id", "text").collect()
    }
    assert got == brute_dedup(rows)


def test_substring_dedup_of_odd_tables(spark):
    assert substring_dedup.dedup(documents(spark, []), "doc_id", "text").count() == 0
    long = " ".join(prose(1, 40))
    rows = [(None, long), (1, long), (1, long), (2, "x\ny")]
    out = substring_dedup.dedup(documents(spark, rows), "doc_id", "text", as_is=True, carry=("id", "kept", "n")).collect()
    assert len(out[0]) == 7
    assert sorted(((r[0], r[1], r[2]) for r in out), key=str) == sorted([(None, 40, 0), (1, 40, 0), (1, 40, 0), (2, 2, 0)], key=str)
    assert {r[3] for r in out if r[0] == 2} == {"x\ny"}


VECS = "vec_id long, embedding array<float>, label int, id string, rep long, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y") for i, v in rows], VECS).repartition(3)


def cloud(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 : n // 2 + 60] = x[3] + rng.normal(scale=0.2, size=(60, d))
    x[n // 2 + 60 : n // 2 + 90] = x[5]
    x[n // 2 + 90 : n // 2 + 130] = x[:40] + rng.normal(scale=0.42, size=(40, d))
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]


ODD = [
    (9001, None), (9002, [1.0, None] + [0.0] * 14), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (9005, [0.0] * 16), (9006, [1.0] * 8),
    (9007, []), (None, [1.0] * 16)
]


def test_embedding_dedup_against_brute_force(spark):
    rows = cloud()
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    union = Union()
    for a, b in zip(*np.nonzero(link), strict=True):
        union.join(int(a), int(b))
    out = embedding_imi.dedup(vectors(spark, rows + ODD), "vec_id", "embedding", 0.9).collect()
    got = {r["vec_id"]: r for r in out}
    degree = link.sum(1) - 1
    found = np.array([got[k]["n_links"] for k, _ in rows])
    assert (found <= degree).all() and found.sum() >= 0.9 * degree.sum() > 0
    assert sum(got[k]["component_id"] == union.root(k) for k, _ in rows) >= 0.97 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in ODD if i)
    assert embedding_imi.dedup(vectors(spark, []), "vec_id", "embedding").count() == 0


def brute_topk(rows, k=5):
    """{query: its k best (vec_id, score)}, by rows: every row of another id counts, for every row of the query's id."""
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    every = {q: sorted((-int(a @ b), j) for i, a in whole if i == q for j, b in whole if i != j and len(a) == len(b)) for q, _ in rows if q % 50 == 0}
    return {q: [(j, -s) for s, j in best[:k]] for q, best in every.items() if best}


def topk_of(out):
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.float32(rng.integers(-2, 3, 6) / 4)]) for k in range(300)] + [(400, [1.0] * 6), (400, [1.0] * 6)]  # many ties
    df = vectors(spark, rows + [r for r in ODD if r[1] is None or len(r[1]) not in (6, 16)] + [(9003, [float("nan")] * 6), (None, [1.0] * 6)])
    out = topk_search.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5).collect()
    assert topk_of(out) == brute_topk(rows)
    few = topk_search.search(vectors(spark, [(0, [1.0]), (1, [-3e6])]), "vec_id", "embedding", F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 256 * -768_000_000)]
    assert topk_search.search(vectors(spark, []), "vec_id", "embedding", F.lit(True)).count() == 0


def test_topk_counts_repeated_rows(spark):
    rows = [(50, [1.0, 0.5]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [0.5, 0.5]), (100, [0.25, 1.0]), (100, [0.25, 1.0])]
    out = topk_search.search(vectors(spark, rows), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5).collect()
    assert topk_of(out) == brute_topk(rows)
    assert topk_of(out)[50] == [(7, 98304), (7, 98304), (100, 49152), (100, 49152), (8, 49152)][:2] + sorted([(8, 49152), (100, 49152), (100, 49152)])
    for bad in ([1e30, 1.0], [3e7, 1e8]):
        with pytest.raises(Exception, match="scale the vectors"):
            topk_search.search(vectors(spark, [(0, bad), (1, [3e15, 3e15]), (2, bad)]), "vec_id", "embedding", F.col("vec_id") == 0, k=5)


def test_embedding_links_at_the_threshold(spark, monkeypatch):
    """Planted pairs and groups just over and under the threshold among many vectors; small chunks, so rows and cells are cut."""
    rng = np.random.default_rng(12)
    n, d = 20_000, 32
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for at in range(0, 6000, 2):  # one partner each, cosine 0.9 to 0.97
        u = rng.normal(size=d)
        u -= (u @ x[at]) * x[at]
        c = rng.uniform(0.88, 0.97)
        x[at + 1] = c * x[at] + np.sqrt(1 - c * c) * u / np.linalg.norm(u)
    x[6000:6400] = x[6000] + rng.normal(scale=0.03, size=(400, d))  # a full cell
    x = np.float32(x)
    monkeypatch.setattr(embedding_imi, "CHUNK", 64)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_imi.dedup(vectors(spark, rows), "vec_id", "embedding", 0.9).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    degree = np.concatenate([(u[k : k + 2000] @ u.T >= 0.9).sum(1) for k in range(0, n, 2000)]) - 1
    found = np.array([got[k] for k in range(n)])
    assert (found <= degree).all()
    pairs = degree[:6000].sum()
    recall = found[:6000].sum() / pairs, found.sum() / degree.sum()
    print("recall of pairs near the threshold and of all links:", recall, pairs)
    assert pairs > 3000 and min(recall) >= 0.95


def test_crc_of_parts():
    import zlib

    a, b, c = b"hello", b"", b"world!" * 50
    assert crc_parts([(zlib.crc32(x), len(x)) for x in (a, b, c)]) == zlib.crc32(a + b + c)


def edited(seed, base, edits):
    rng, out = random.Random(seed), list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(40)}"
    return " ".join(out)


@pytest.mark.parametrize("together", [2, 5, 512])
def test_ngram_join_splits_large_groups(spark, together):
    """Groups larger than what a task compares go on as differences from their majority; no link is lost."""
    base, other = prose(21, 90, [f"b{k}" for k in range(4000)]), prose(22, 60, [f"o{k}" for k in range(4000)])
    rows = [(k, edited(k, base, k % 5)) for k in range(90)] + [(300 + k, edited(k, other, k % 3)) for k in range(30)] + [
        (500 + k, edited(7, base, 3)) for k in range(3)
    ]
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in ngram_join.join(documents(spark, rows), "doc_id", "text", together=together).collect()
    }
    assert got == brute_join(rows)


def test_topk_with_empty_vectors(spark):
    rows = [(0, []), (50, []), (1, [1.0, 2.0]), (100, [0.5, 0.5]), (2, [])]
    out = topk_search.search(vectors(spark, rows), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5).collect()
    assert [tuple(r) for r in out] == [(100, 1, 1, 128 * 256 + 128 * 512)]


def test_embeddings_of_one_component_link_by_sign(spark):
    rows = [(1, [1.0]), (2, [2.0]), (3, [-0.5]), (4, [-7.0]), (5, [0.0]), (6, []), (7, [3.5]), (8, [1.0])]
    out = {
        r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_imi.dedup(vectors(spark, rows), "vec_id", "embedding").collect()
    }
    assert out == {
        1: (3, 1, True), 2: (3, 1, False), 7: (3, 1, False), 8: (3, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True), 6: (0, 6, True)
    }


def test_topk_broadcasts_no_blocks(spark, monkeypatch):
    plans = []
    for name in ("save", "finish"):
        plain = getattr(topk_search, name)
        monkeypatch.setattr(
            topk_search, name, lambda df, *a, plain=plain: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, *a))[1]
        )
    rows = [(i, [-0.5, (i * 37 % 101) / 100]) for i in range(300)]
    out = topk_search.search(vectors(spark, rows), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5).collect()
    want = lambda q: sorted((-(16384 + int(256 * rows[q][1][1]) * int(256 * v[1])), i) for i, v in rows if i != q)[:5]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == [
        (q, k, i, -s) for q in range(0, 300, 50) for k, (s, i) in enumerate(want(q), 1)
    ]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)

"""Line dedup, vector code compression and spelling variants against plain versions, and their awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import corpus, documents, prose
from pyspark.sql import functions as F
from test_pairs import vectors

from quillspark.llm import code_lloyd, line_dedup, spelling_trie

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def small(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_lines(rows, size=40, least=5):
    keys = [[small(line.strip(BLANK)) for line in (t or "").split("\n")] for _, t in rows]
    met = Counter(k for ks in keys for k in set(ks) if len(k) >= size)
    last = {}
    for (i, _), ks in zip(rows, keys, strict=True):
        for k in set(ks):
            last[k] = max((x for x in (last.get(k), i) if x is not None), default=None)
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, ks, strict=True) if met[k] < least or last[k] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(4)
    shared = ["The Licence of this text is granted to everyone who reads it, number %d." % k for k in range(12)]
    accents = "é" * 39 + "x"
    rows = []
    for k in range(120):
        lines = [" ".join(prose(k * 50 + j, rng.randint(0, 20))) for j in range(rng.randint(1, 12))]
        lines += rng.sample(shared, rng.randint(0, 4)) + ["\t" + shared[0].upper() + " \r"] * (k % 3 == 0)
        lines += [accents] * (k % 9 == 0) + [accents[1:]] * (k % 9 == 1) + ["short line"] * 2
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    twice = shared[1] + "\n" + shared[1] + "\n\n" + shared[2]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, twice), (203, twice), (204, shared[3] + " " * 500), (205, "\n".join(shared) * 400)]


def lines_of(out):
    return sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


def test_line_dedup(spark):
    rows = line_rows()
    want = brute_lines(rows)
    assert sum(r[2] for r in want) > 100
    assert lines_of(line_dedup.dedup(documents(spark, rows, 7), "doc_id", "text")) == want


def test_line_dedup_with_full_filters(spark, monkeypatch):
    """Filters far too small know every key: more is shuffled, the result is the same. Tasks that send often give the same as well."""
    monkeypatch.setattr(line_dedup, "MOST_BITS", line_dedup.SEGMENTS * 8)
    monkeypatch.setattr(line_dedup, "HELD", 10)
    rows = line_rows()
    assert lines_of(line_dedup.dedup(documents(spark, rows, 5), "doc_id", "text")) == brute_lines(rows)


def test_line_dedup_sends_suspects_only(spark):
    rows = [(k, f"{k} " + " ".join(prose(k, 30)) + ("\n" + "A line that five texts hold, long enough." if k < 5 else "")) for k in range(3000)]
    texts = documents(spark, rows).select("text", F.xxhash64("doc_id").alias("who"), F.col("doc_id").alias("id"))
    known, bits = line_dedup.twice_seen(texts.select("text"), 40)
    assert 5 <= line_dedup.suspects(texts, 40, known, bits).count() < 150


def test_line_dedup_of_odd_tables(spark):
    assert line_dedup.dedup(documents(spark, []), "doc_id", "text").count() == 0
    key = "a line of more than forty characters, all the same"
    rows = [(None, key)] * 3 + [(1, key), (2, key + "\nrest")]
    assert lines_of(line_dedup.dedup(documents(spark, rows), "doc_id", "text")) == brute_lines(rows)
    alone = [(None, key)] * 6 + [(3, "x")]
    assert lines_of(line_dedup.dedup(documents(spark, alone), "doc_id", "text")) == brute_lines(alone)
    same = [(7, key)] * 6 + [(7, key + "\ny")]
    assert all(r[2] == 0 for r in lines_of(line_dedup.dedup(documents(spark, same), "doc_id", "text")))


def test_line_dedup_when_a_line_is_in_most_texts(spark):
    key = "this very line stands in almost every text of the table"
    rows = [(k, f"{key}\nown {k}\n{key.upper()}") for k in range(4000)]
    got = lines_of(line_dedup.dedup(documents(spark, rows, 8), "doc_id", "text"))
    assert got == brute_lines(rows) and sum(r[2] for r in got) == 2 * 3999


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    x = np.array([[int(np.floor(scale * c)) for c in v] for _, v, _ in rows], dtype=object)
    cuts = code_lloyd.cuts_of(x.shape[1], parts)
    books = [[list(v[a:z]) for v in x[:entries]] for a, z in cuts]
    far = lambda v, c: sum((p - q) ** 2 for p, q in zip(v, c, strict=True))
    place = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[a:z], books[p][e]), e)) for p, (a, z) in enumerate(cuts)] for v in x]
    for _ in range(rounds):
        codes = place()
        for p, (a, z) in enumerate(cuts):
            for e in range(len(books[p])):
                own = [v[a:z] for v, c in zip(x, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    codes = place()
    errors = [sum(far(v[a:z], books[p][c[p]]) for p, (a, z) in enumerate(cuts)) for v, c in zip(x, codes, strict=True)]
    by = defaultdict(int)
    for (_, _, label), e in zip(rows, errors, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{e:02x}" for e in c), err, by[label], digest) for (i, _, label), c, err in zip(rows, codes, errors, strict=True)), key=str
    )


def labelled(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", b"y") for i, v, label in rows], "vec_id long, embedding array<float>, label int, id string, data binary").repartition(5)


def codes_of(out):
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def clusters(n, d, seed, step=None):
    """Vectors around centres; step: components on a coarse grid, which makes many ties."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(9, d))[rng.integers(9, size=n)] + rng.normal(scale=0.3, size=(n, d))
    x = np.round(x / step) * step if step else x
    return [(k, [float(np.float32(c)) for c in v], None if k % 7 == 0 else k % 3) for k, v in enumerate(x)]


@pytest.mark.parametrize("n,d,step", [(600, 32, None), (500, 16, 0.5), (300, 8, 1.0), (200, 20, None), (11, 24, None), (40, 5, 0.25)])
def test_codes_against_plain_rounds(spark, n, d, step):
    rows = clusters(n, d, n + d, step)
    assert codes_of(code_lloyd.compress(labelled(spark, rows), "vec_id", "embedding", F.col("label"))) == brute_codes(rows)


def test_codes_skip_groups(spark):
    scans = []
    rows = clusters(3000, 32, 5)
    code_lloyd.compress(labelled(spark, rows), "vec_id", "embedding", F.col("label"), scans=scans)
    assert scans[0] == 3000 * 8 * 16 and len(scans) == 7
    assert scans[-1] < 0.7 * scans[0] and all(a < scans[0] for a in scans[1:])


def test_codes_of_odd_tables(spark):
    rows = clusters(60, 16, 3, 0.5)
    odd = [
        (900, None, 1), (901, [1.0, None] + [0.0] * 14, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1), (904, [], 1), (905, [1.0] * 8, 1),
        (None, [1.0] * 16, 1)
    ]
    rows += [rows[5], (5, [0.25] * 16, 2), rows[40]]  # repeated rows, several vectors of one id
    assert codes_of(code_lloyd.compress(labelled(spark, rows + odd), "vec_id", "embedding", F.col("label"))) == brute_codes(rows)
    assert code_lloyd.compress(labelled(spark, odd[:5]), "vec_id", "embedding", F.col("label")).count() == 0
    one = code_lloyd.compress(labelled(spark, [(3, [0.5] * 16, None)]), "vec_id", "embedding", F.col("label"))
    assert codes_of(one) == brute_codes([(3, [0.5] * 16, None)])
    large = [(k, [1000.0 * (k + j) for j in range(8)], 0) for k in range(40)]  # squares beyond 53 bits
    assert codes_of(code_lloyd.compress(labelled(spark, large), "vec_id", "embedding", F.col("label"))) == brute_codes(large)
    with pytest.raises(Exception, match="too large"):
        code_lloyd.compress(labelled(spark, [(1, [1e30] * 16, 0)]), "vec_id", "embedding")
    plain = code_lloyd.compress(vectors(spark, [(k, [float(k)] * 8) for k in range(30)]), "vec_id", "embedding").collect()
    assert len({r["label_error"] for r in plain}) == 1 and sum(r["error"] for r in plain) == plain[0]["label_error"]


def brute_words(rows, size=6, least=5, times=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = small(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= size:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    letters = sorted(set("".join(n)))
    near = {}
    for w in n:
        some = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}
        near[w] = (some | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}) & set(n) - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def words_of(out):
    return sorted((tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def word_rows():
    rng = random.Random(6)
    stems = ["wonder", "letter", "aaaaaaaa", "aaaaaaa", "ababababab", "bababababa", "élégant", "strasse", "Straße", "naïveté", "×÷×÷×÷×"]
    stems += ["".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for _ in range(60)]
    rows = []
    for k in range(60):
        text = []
        for s in stems:
            for _ in range(rng.choice((0, 1, 1, 8))):
                at, kind = rng.randrange(len(s)), rng.randrange(8)
                text.append(s[:at] + {0: "", 1: "z" + s[at], 2: "q"}.get(kind, s[at]) + s[at + 1 :] if kind < 3 else s.upper() if kind == 3 else s)
        rows.append((k, " ".join(text) + "\nand, of5wonder_wonder"))
    chain = "correctly " * 2000 + "corectly " * 300 + "corectl " * 40 + "corctl " * 6
    return rows + [(500, chain), (501, chain), (None, chain), (502, None), (503, ""), (504, ("y" * 3000 + " ") * 6 + ("y" * 2999 + " ") * 40), (60, rows[3][1]), (60, rows[3][1])]


def test_spelling_variants(spark, monkeypatch):
    rows = word_rows()
    want = brute_words(rows)
    by = {r[0]: r for r in want}
    assert by["corctl"][2] == "correctly" and any(r[1] for r in want) and len(want) > 100
    assert words_of(spelling_trie.variants(documents(spark, rows), "doc_id", "text")) == want
    monkeypatch.setattr(spelling_trie, "SHARD", 300)  # many tries, each of a broadcast of its own
    monkeypatch.setattr(spelling_trie, "BATCH", 9000)
    monkeypatch.setattr(spelling_trie, "HELD", 20)
    assert words_of(spelling_trie.variants(documents(spark, rows), "doc_id", "text")) == want


def test_spelling_variants_of_odd_tables(spark):
    assert spelling_trie.variants(documents(spark, []), "doc_id", "text").count() == 0
    assert spelling_trie.variants(documents(spark, [(1, "short words only"), (2, None)]), "doc_id", "text").count() == 0
    rows = [(k, t) for k, t in corpus() if k != 85]
    assert words_of(spelling_trie.variants(documents(spark, rows), "doc_id", "text")) == brute_words(rows)


def test_automaton_meets_every_neighbour_once():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    trie = spelling_trie.Trie.load(*spelling_trie.Trie.of(words, list(range(1, len(words) + 1))).dump())
    count = {w: k + 1 for k, w in enumerate(words)}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    pair = spelling_trie.Pair.of(words, list(range(1, len(words) + 1)))
    for w in [*words, "", "c", "abc", "bbbbbbbbb"]:
        want = sorted((x, count[x]) for x in words if one(w, x))
        assert sorted(trie.near(w)) == want and sorted(pair.near(w).items()) == want

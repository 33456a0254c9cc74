import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import corpus, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import packing
from quillspark.llm.byte_bpe import encode_decode, merger

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "", " ", "  a  b ", "a\n b", "\n\n x", "aaaa" * 500, "é" * 200, "a " + "b" * 3000 + " c", "!" * 129, "x" * 64 + " " + "y" * 65, "it's we'll",
    "　 日本\x1c語", "<|endoftext|> x", "a  b", "tab\t tab"
]


def test_byte_bpe(spark, encoding):
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(ODD)] + [(1000, ""), (None, "x y")]
    out = encode_decode(documents(spark, rows), "doc_id", "text", PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        t = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(t)
        assert r["n_tokens"] == len(r["ids"]) // 4 and bytes(r["decoded"]) == t.encode()
    assert encode_decode(documents(spark, []), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80) | st.text("ab '\n\té!1", max_size=200))
def test_byte_bpe_of_any_text(encoding, text):
    m = merger(PATH, public_tokenizers.PATTERN)
    ids = m.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text) and m.decode(ids) == text.encode()


def test_long_and_short_merges_agree():
    m, rng = merger(PATH, public_tokenizers.PATTERN), random.Random(4)
    pieces = [bytes(rng.choice(b"the ring") for _ in range(rng.randint(1, 64))) for _ in range(400)]
    assert m.merge_batch(pieces) == [m.merge_long(p) for p in pieces]


def check_packing(out, rows, window=2048):
    tok = Tokenizer.from_file(WORDS)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        if len(ids) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids[0]) // 4
                assert zlib.crc32(ids[0][4 * at : 4 * (at + r["length"])]) == r["ids_crc32"]
                at += r["length"]
            assert at == len(ids[0]) // 4
        else:
            assert sum(r["length"] for r in pieces[i]) == sum(len(x) // 4 for x in ids)
    padding = total = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        total += at
    return padding, total


def test_packing(spark):
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(ODD)] + [(0, "again"), (2000, "w " * 2047), (2001, "w " * 4096)]
    rows += [(3000 + k, "w " * (37 * k % 1900)) for k in range(300)]
    out = packing.pack(documents(spark, rows), "doc_id", "text", WORDS).collect()
    padding, total = check_packing(out, rows)
    assert padding < 2048 + 0.01 * total
    assert packing.pack(documents(spark, []), "doc_id", "text", WORDS).count() == 0
    check_packing(packing.pack(documents(spark, [(1, None), (2, "")]), "doc_id", "text", WORDS).collect(), [(1, None), (2, "")])


def test_chunks_have_the_ids_of_the_whole_text():
    tok, c = Tokenizer.from_file(WORDS), packing.chunks(WORDS)
    texts = [*ODD, "Héllo Été, Éá STRASSE ß. don't A.B. i̇ ﬁ <|startoftext|>x Ünï!! ###"]
    assert c.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_least_squares():
    columns = packing.combinations(64, 8)
    assert all(sum(a * t for a, t in c) == 64 for c in columns)
    target = np.zeros(65)
    for a, t in columns[5]:
        target[a] += 40 * t
    x = packing.nnls(columns, target, 5000, 1e-4)
    made = np.zeros(65)
    for n, c in zip(x, columns, strict=True):
        for a, t in c:
            made[a] += n * t
    assert (x >= 0).all() and np.abs(made - target).max() < 1


def test_line_ends_cut_chunks():
    """Words on both sides of a line's end are known words, not a new chunk for each pair; the ids stay those of the whole text."""
    tok, c = Tokenizer.from_file(WORDS), packing.Chunks(WORDS)
    texts = ["The end.\nNew line\n\n next\r\nlast\n", "\n", "é\ńx a\n<|endoftext|>\nb <|endof\ntext|>", "don'\nt it\n's", "1\n2\t3\n\x1c\n日本\n語", "end.\nend.\nThe\nThe new\nline"]
    got = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert not any("\n" in x for x in c.kept) and {"end.", "New", "line"} <= c.kept.keys()

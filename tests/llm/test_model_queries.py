"""The registered queries of the two classifiers, over a whole small folder, against plain versions and held-out rows."""

import zlib
from collections import Counter

import numpy as np
from helpers import documents, prose
from test_models import WORDS

from quillspark.llm import language_crf, quality_ftrl, queries
from quillspark.llm.common import held_out


def folder(tmp_path, spark, rows, labels):
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def corpus_of(n=240):
    """(doc_id, text, lang): odd ones French; every third one junk."""
    lang = lambda k: ("en", "fr")[k % 2]
    return [(k, " ".join(w + "***" * (k % 3 == 0) for w in prose(k, 40, WORDS[lang(k)])), lang(k)) for k in range(n)]


def out_of(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_query(spark, tmp_path):
    rows = corpus_of()
    wrong = [(i, t, {"en": "fr", "fr": "en"}[lang] if out_of(i) else lang) for i, t, lang in rows] + [
        (900, None, "en"), (901, "", "en"), (902, " .. ", None)
    ]
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, folder(tmp_path, spark, wrong, [(1, 1, 0)])).collect()}
    assert set(got) == {i for i, *_ in wrong} and all(r["held_out"] == out_of(i) for i, r in got.items())
    # Held-out labels, here all wrong, teach nothing: predictions follow the texts.
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if out_of(i)]) > 0.97
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    # The score is the mean posterior over all label paths, worked out word by word.
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_crf.fit(docs, "doc_id", "text", "lang", ~held_out(docs["doc_id"]))
    for i, t, _ in rows[:12]:
        words = [w for w in map(language_crf.lowered, t.encode().split()) if w][:40]
        emit, start, trans = np.exp(model.scores(words).astype(float)), np.exp(model.start), np.exp(model.trans)
        alpha, beta = [start * emit[0]], [np.ones(len(start))]
        for e in emit[1:]:
            alpha.append(alpha[-1] @ trans * e)
        for e in emit[:0:-1]:
            beta.append(trans @ (e * beta[-1]))
        post = np.array(alpha) * np.array(beta[::-1])
        mean = (post / post.sum(1, keepdims=True)).mean(0)
        assert model.langs[int(mean.argmax())] == got[i]["lang_pred"] and abs(mean.max() - got[i]["score"]) < 1e-3


def plain_score(text, model):
    """The mean weight of all n-grams and the bias, n-gram by n-gram."""
    weights, bias = model
    count = Counter(quality_ftrl.indices(text.encode().split(), quality_ftrl.Symbols()).tolist())
    total = sum(count.values())
    return 1 / (1 + np.exp(-(sum(float(weights[i]) * n for i, n in count.items()) / max(1, total) + bias)))


def test_quality_query(spark, tmp_path):
    rows = corpus_of()
    good = lambda i: int(i % 3 != 0)
    labels = [(i, 1 - good(i) if out_of(i) else good(i), 0) for i, *_ in rows if i % 5]
    at = folder(tmp_path, spark, rows + [(900, None, None), (901, "", None)], labels)
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, at).collect()}
    assert set(got) == {i for i, *_ in rows} | {900, 901} and all(r["held_out"] == out_of(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert np.mean([(got[i]["score"] >= 0.5) == good(i) for i, *_ in rows if out_of(i)]) > 0.95
    docs, marks = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = quality_ftrl.fit(docs, marks, "doc_id", "text", "quality", ~held_out(marks["doc_id"]))
    assert all(abs(got[i]["score"] - plain_score(t, model)) < 1e-4 for i, t, _ in rows)
    assert got[900]["score"] == got[901]["score"]


def test_counts_of_a_very_long_training_text(spark):
    """An n-gram may occur more often than 16 bits can count."""
    long = "word " * 70_000 + "other"
    docs = documents(spark, [(k, long if k == 0 else " ".join(prose(k, 30)), "en") for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    weights, _ = quality_ftrl.fit(docs, labels, "doc_id", "text", "quality", labels["doc_id"].isNotNull())
    often = int(quality_ftrl.indices([b"word"], quality_ftrl.Symbols())[0])
    assert weights[often] < 0

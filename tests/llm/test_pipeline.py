import os
import sys

from helpers import corpus, documents, prose
from pyspark.sql import functions as F
from test_models import brute_secrets
from test_pairs import brute_dedup, brute_join
from test_tokens import check_packing

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(prose(k, 60)) for k in range(4))
    near = " ".join([*a.split()[:-1], "edit"])
    rows = [(5, a), (5, a), (3, near), (None, a), (None, b), (None, b), (7, c), (7, c), (7, d)]
    out = corpus_pipeline.one_of_each_group(spark, documents(spark, rows), "")
    assert out.columns == documents(spark, rows).columns
    assert sorted(map(str, (tuple(r) for r in out.select("doc_id", "text").collect()))) == sorted(map(str, [(3, near), (None, b), (7, c), (7, d)]))


TONGUES = {
    "en": ["the", "thing", "with", "wash", "ring"], "fr": ["été", "oiseau", "château", "aux"], "de": ["über", "straße", "zwölf", "jäger"],
    "pl": ["żółw", "ćma", "źdźbło", "łąka"]
}


def test_mixed_texts_stay_if_their_words_are_sure(spark):
    rows = [(k, " ".join(prose(k, 40, TONGUES[lang])), lang) for k in range(160) for lang in [list(TONGUES)[k % 4]]]
    rows += [(900, " ".join(w for k, ws in enumerate(TONGUES.values()) for w in prose(k, 30, ws)), "en"), (901, "12 ...", "en"), (902, None, "en")]
    rows += [(903, "все люди рождаются свободными и равными в своем достоинстве и правах " * 5, None), (904, "thing", None)]
    out = corpus_pipeline.language_id(spark, documents(spark, rows), "")
    assert out.columns == documents(spark, rows).columns
    assert {r["doc_id"] for r in out.collect()} == {*range(160), 900, 904}


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    key = "é token = \"abcdefghijkl\" x"
    rows = corpus() + [(200 + k, " ".join(prose(900 + k, 25)) + f" {key}") for k in range(5)] + [(300, "12 34 ...")]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    saved = {}
    keep = corpus_pipeline.save
    monkeypatch.setattr(corpus_pipeline, "save", lambda df, tag: saved.setdefault(tag, keep(df, tag)))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    at = {k: {r["doc_id"]: r["text"] for r in saved[k].collect()} for k, _ in corpus_pipeline.STAGES[:4]}
    assert all(saved[k].count() == len(at[k]) for k in at)
    # One language is learnt here, so whatever has a letter is told surely.
    told = {i: t for i, t in rows if any(map(str.isalpha, t or ""))}
    assert at["language_id"] == told
    assert at["ngram_join"] == {i: told[i] for i, (_, c) in brute_join(list(told.items())).items() if i == c}
    dedup = brute_dedup(list(at["ngram_join"].items()))
    assert {i: t.split() for i, t in at["substring_dedup"].items()} == {i: kept.split() for i, (n, gone, kept) in dedup.items() if n > gone}
    assert all(t == told[i] for i, t in at["substring_dedup"].items() if not dedup[i][1])
    clean = {}
    for i, t in at["substring_dedup"].items():  # fewer than 20 findings: only base matches
        for a, _, z in sorted(brute_secrets(t), reverse=True):
            t = t[:a] + "<secret>" + t[z:]
        clean[i] = t
    assert at["secret_scan"] == clean and sum("<secret>" in t for t in clean.values()) == 5
    padding, total = check_packing(out, list(clean.items()))
    assert total and padding < 2048 + 0.05 * total


def test_stages_take_columns_that_clash(spark):
    """Columns named as the operators' own ones go through every stage but the last, unchanged."""
    names = (
        "n_words", "n_removed", "kept", "rest", "component_id", "n_shingles", "row", "found", "spans", "_row_tag", "whole", "a.b", "x`y", "first", "a b,c",
        "carry", "late", "none"
    )
    rows = [(1, " ".join(prose(1, 60))), (2, " ".join(prose(2, 60))), (2, " ".join(prose(2, 60))), (None, " ".join(prose(3, 60))), (3, None)]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k).cast("long"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.save(stage(spark, docs, ""), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    got = docs.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 2), (True, 0)]
    assert all(r[name] == k for r in got for k, name in enumerate(names))


def test_stages_without_other_columns(spark):
    """Only id, text and language: nothing to count characters in, nothing else to hand through."""
    rows = [(1, " ".join(prose(1, 60))), (2, " ".join(prose(2, 60)) + ' token = "abcdefghijkl"'), (3, None)]
    docs = documents(spark, rows).select("doc_id", "text", "lang")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.save(stage(spark, docs, ""), "stage")
        assert docs.columns == ["doc_id", "text", "lang"]
    assert {r["doc_id"]: "<secret>" in r["text"] for r in docs.collect()} == {1: False, 2: True}
    bare = documents(spark, rows).select("doc_id", "text")
    assert corpus_pipeline.language_id(spark, bare, "").count() == 0
    for _, stage in corpus_pipeline.STAGES[1:4]:
        bare = corpus_pipeline.save(stage(spark, bare, ""), "stage")
        assert bare.columns == ["doc_id", "text"]
    assert sorted(r["doc_id"] for r in bare.collect()) == [1, 2]


def test_stages_of_an_empty_table(spark):
    docs = documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.save(stage(spark, docs, ""), "stage")
    assert docs.count() == 0 and "sequence_id" in docs.columns

"""Five stages that turn `documents` into packed training sequences; each stage's result is written and read again.

1. language_id: documents whose language can't be told (no letter, or words whose largest posteriors have too low a mean, see
   SURE) go; a text in several languages stays if its words are told surely.
2. ngram_join: of each group of near copies exactly one row stays, that with the smallest id. Each row is a document of its
   own, whatever its id: a repeated row goes, rows of one id with different texts are different documents, and rows with a
   null id are grouped by their text like all others and stay only if their group has no id.
3. substring_dedup: words of repeated passages go, whatever document they are in; a document left without words goes. What
   stage 2 leaves of rows with one id counts as one place there, and rows with a null id take no part.
4. secret_scan: secrets are replaced by a mark.
5. packing: pieces of the remaining documents in sequences of 2048 tokens.

All but the last return the columns of `documents`, whatever their names. A column that describes the text (n_chars) follows it where there is one;
without a lang column no language is learnt, so no document is told surely and all go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language_crf, ngram_join, secret_cnn, substring_dedup
from quillspark.llm.common import held_out, quoted, save, table
from quillspark.llm.packing import pack

#: Words of texts in the languages learnt, one or several of them, have posteriors near 1, those of others less; the bar falls by SLACK for a text of one
#: word, by a sixth of it for one of 36.
SURE, SLACK = 0.7, 0.3
#: A row's number and all its columns as one, by which stage 2 tells rows of one id apart and hands them through under any names.
ROW, WHOLE = "row", "whole"


def columns_of(docs: DataFrame, whole: str, own: dict[str, Column]) -> list[Column]:
    """The columns of docs out of the struct `whole`, but those in `own`."""
    return [(own[c] if c in own else F.col(whole).getField(c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    model = language_crf.fit(known, "doc_id", "text", "lang", ~held_out(F.col("doc_id")))
    return language_crf.surely(docs, "text", model, SURE, SLACK)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(WHOLE)
    tagged = save(docs.select(F.monotonically_increasing_id().alias(ROW), whole), "tagged")  # written, so that a row keeps its number
    at = F.col(WHOLE)
    groups = ngram_join.join(tagged.select(ROW, at.getField("text").alias("text")), ROW, "text", n=4, percent=85)
    own = tagged.select(ROW, at.getField("doc_id").alias("doc_id")).join(groups.select(ROW, "component_id"), ROW)
    stay = own.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")).select(
        F.col(f"first.{ROW}").alias(ROW)
    )
    # The same plan at every size; neither side is ever broadcast.
    return tagged.join(stay.hint("merge"), ROW, "left_semi").select(*columns_of(docs, WHOLE, {}))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Apart from dedup's own columns; never without a field.
    others = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rest = F.struct(*(others or [F.lit(0).alias("none")])).alias("rest")
    out = substring_dedup.dedup(
        docs.select("doc_id", "text", rest), "doc_id", "text", window=20, as_is=True, carry=("rest",)
    ).filter("n_words > n_removed")
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*columns_of(docs, "rest", own))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_cnn.redact(docs, "doc_id", "text")
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("secret_scan", without_secrets),
    ("packing", packing),
]

#: The models and the tokenizer have no SQL form; tests/llm/test_pipeline.py compares a run with brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs

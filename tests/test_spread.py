"""Queries whose rows make much work each: spread over tasks, and each step of a row done once."""

import time

from pyspark.sql import functions as F

from quillspark.operators import layout
from quillspark.plans import planted


def test_planted_messages_are_dealt_out_and_read_once(spark):
    found = planted.entities_planted(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == 4
    assert found._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython ") == 1
    assert found.select("id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_headline_of_many_lines_is_linear(spark):
    n = 6000
    line = lambda k: F.struct(F.concat(F.lit("line number "), k).alias("text"), (k / n).cast("float").alias("top"), ((k + F.when(k == 1, 0.9).otherwise(0.3)) / n).cast("float").alias("bottom"))
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n) + F.col("id").cast("int")), line).alias("lines"))
    began = time.time()
    assert df.select(layout.headline(F.col("lines")).alias("h")).first()["h"] == "line number 1"
    assert time.time() - began < 20  # minutes, when the median was worked out again for each line


def test_many_queries_makes_no_snippets(spark, monkeypatch):
    from quillspark.operators import many
    from quillspark.plans import stored

    def made(*_):
        raise AssertionError("the query returns no snippets")

    monkeypatch.setattr(many, "snippet_at", made)
    found = stored.many_queries(spark, "/root/testdata/sf0.001")
    assert found.columns == ["q", "id", "tier", "rank", "reason"] and found.count() == 4219

import numpy as np
from helpers import documents, prose
from pyspark.sql import functions as F

from quillspark.llm import quality_ftrl


def test_quality_counts_of_very_long_documents(spark, monkeypatch):
    n = 1 << 16
    docs = documents(spark, [(1, "same " * n), (2, " ".join(prose(1, 50)))])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_ftrl, "train", lambda rows: seen.extend(rows) or (np.zeros(1 << quality_ftrl.BITS, np.float32), 0.0))
    quality_ftrl.fit(docs, labels, "doc_id", "text", "quality", F.lit(True))
    i, c, _ = next(r for r in seen if r[2] == 1)
    want, times = np.unique(quality_ftrl.indices([b"same"] * n, quality_ftrl.Symbols()), return_counts=True)
    assert (i == want).all() and np.allclose(c, times / times.sum())


def test_shape_of_a_whole_word():
    s = quality_ftrl.Symbols()
    assert s[b"a" * 300] & 0xFFFFFFFF == s[b"a"] & 0xFFFFFFFF != s[b"a" * 300 + b"1"] & 0xFFFFFFFF

import numpy as np
from pyspark.sql import functions as F
from test_pairs import vectors

from quillspark.llm import topk_search


def test_topk_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 90, [float(x) for x in np.float32(rng.integers(-9, 9, 6) / 4)]) for k in range(240)]
    rows += [(7, [9.0] * 6), (7, [-9.0] * 6), (0, [5.0, -5.0] * 3), (3, [1.0] * 4), (50, [1.0] * 4)]
    out = topk_search.search(vectors(spark, rows), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5).collect()
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    for q in (0, 50):
        best = sorted((-int(a @ b), j) for i, a in whole for j, b in whole if i == q != j and len(a) == len(b))[:5]
        assert [
            (r["vec_id"], r["score"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        ] == [(j, -s) for s, j in best]
    assert len(out) == 10

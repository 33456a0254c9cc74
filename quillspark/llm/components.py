"""Connected components of a graph that no single task could hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch's edges a star forest with the same components: each node with the smallest that it reaches."""
    for b in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (p := parent.get(top, top)) != top:
                top = p
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            parent.setdefault(u, a)
            parent.setdefault(v, c)
            if a != c:
                parent[max(a, c)] = min(a, c)
        star = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([x for x, _ in star], np.int64)), pa.array(np.array([r for _, r in star], np.int64))], names=["u", "v"]
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (u, v: long) with the smallest one that it reaches. Large-star and
    small-star steps in turn, each a minimum by node (combined before the shuffle) and an inner join, until all edges are stars."""
    edges = save(edges.filter("u <> v").mapInArrow(contract, "u long, v long").distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
        if (now["n"], now["h"]) == seen or now["n"] == now["nodes"] and edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi").isEmpty():
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
            out._saved_at = edges._saved_at  # for forget()
            return out
        seen = (now["n"], now["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # The minimum itself must keep its node: (u, m) comes from the row with v = m, which every u has.
        after = save(small.distinct(), "edges")
        forget(edges)
        edges = after

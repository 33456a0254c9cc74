"""Steps that several operators share: values bound once, rows written once, places in a total order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import delete, shared_dir


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each worked out once a row. A generated row of one keeps the optimiser from writing their
    expressions out wherever they are used."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what follows may read it several times. done_with() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Deletes tables of written(), or those behind results of numbered(), that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._written_at)


def numbered(df: DataFrame, part: str | list[str], *order: Column) -> DataFrame:
    """df with `rank`: each row's place within its `part` (not null), from 1, in a total order. Rows are sorted by ranges and written, so no
    task holds more than a range; the counts of the ranges make the places whole."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [part] if isinstance(part, str) else part
    by = [F.col(p) for p in parts]
    ranged = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    rows = written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    placed = rows.withColumn("_range", F.shiftright("_at", 33))
    earlier = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_range", *parts).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.select("_range", *parts, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if isinstance(part, str):
        starts = F.broadcast(starts)  # of few parts: a row for each range and part at most
    placed = placed.join(starts, ["_range", *parts]).withColumn("rank", (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int"))
    out = placed.select(*df.columns, "rank")
    out._written_at = rows._written_at
    return out

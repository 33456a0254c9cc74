"""Live behaviour on Structured Streaming: queries that follow their table, bounded draining of a backlog, retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.store import FAILED, INDEXED, PENDING


def arrivals(spark: SparkSession, path: str, schema: StructType, files_per_step: int = 4, newest_first: bool = True) -> DataFrame:
    """New Parquet files of a folder as a stream, a bounded number at a step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).option("latestFirst", str(newest_first).lower()).parquet(path)


def settle(stream: DataFrame, key: str, at: str, quiet: float = 3.0, longest: float = 30.0, replay: bool = False) -> DataFrame:
    """(key, first, last, n): batches of arrivals, each complete `quiet` seconds after its last arrival, or `longest` after its first if they don't
    cease. A stream of rows with their time of arrival in `at`; of each key the state is one open batch (two times and a count),
    kept in the checkpoint, whatever arrives. Timers follow the clock; with `replay` they follow the arrivals' own times (late ones
    are dropped), so a recorded stream gives the same batches whenever it is read. What belongs to a batch are the key's rows from
    first to last."""
    quiet_ms, longest_ms = int(quiet * 1000), int(longest * 1000)
    rows = stream.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at")).filter("at is not null")
    rows = rows.withWatermark("at", "0 seconds") if replay else rows
    timed = GroupStateTimeout.EventTimeTimeout if replay else GroupStateTimeout.ProcessingTimeTimeout

    def batch(k: tuple, first: int, last: int, n: int) -> pd.DataFrame:
        times = [pd.Timestamp(x, unit="ms") for x in (first, last)]
        return pd.DataFrame({"key": [k[0]], "first": [times[0]], "last": [times[1]], "n": [n]})

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield batch(k, *state.get)
            state.remove()
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        due = lambda: min(last + quiet_ms, first + longest_ms)
        for x in sorted(t.value // 1_000_000 for part in parts for t in part["at"]):
            if n and x >= due():
                yield batch(k, first, last, n)
                first, last, n = None, None, 0
            first, last, n = x if first is None else min(first, x), x if last is None else max(last, x), n + 1
        state.update((first, last, n))
        if replay:
            # A timer must lie ahead of the watermark; a batch that is due by then ends with the next step.
            state.setTimeoutTimestamp(max(due(), state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(max(1, due() - state.getCurrentProcessingTimeMs()))

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(
        step, f"key {kind}, first timestamp, last timestamp, n long", "first long, last long, n long", "append", timed
    )


def retractions(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change does to a table, as rows of count_changes(): the rows that it replaces or removes count one less, what it puts in their place one more."""
    signed = lambda df, sign: df.select("state", "categories", "ocr_pending", "favorite", F.lit(sign).cast("long").alias("sign"))
    return signed(before, -1).unionByName(signed(after, 1))


def count_changes(changes: DataFrame) -> DataFrame:
    """(part, name, n): the counts of reads.counts() (part `state`) and reads.category_counts() (part `category`) of all rows put in and
    not taken out again. changes: retractions() rows, as a stream or not. In a stream each count is one number of state, and a step
    touches the counts of the rows that came with it only."""
    flag = lambda c, name: F.when(c, F.lit(name))
    names = F.array(
        F.lit("total"), flag(F.col("state") == INDEXED, "indexed"), flag(F.col("state") == PENDING, "pending"), flag(F.col("state") == FAILED, "failed"),
        flag(F.col("ocr_pending"), "ocr_pending"), flag(F.col("favorite"), "favorites")
    )
    own = F.transform(F.array_compact(names), lambda x: F.struct(F.lit("state").alias("part"), x.alias("name")))
    kinds = F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda x: F.struct(F.lit("category").alias("part"), x.alias("name")))
    return changes.select("sign", F.inline(F.concat(own, kinds))).groupBy("part", "name").agg(F.sum("sign").alias("n"))


def follow_counts(
    changes: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, every: str = "300 milliseconds", once: bool = False
) -> StreamingQuery:
    """Live counts: each step publishes the counts that its changes touched (n is 0 where nothing is left), never the table again."""
    w = count_changes(changes).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def drain(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Works a backlog off in bounded steps and stops; progress survives restarts in the checkpoint folder."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(
    stream: DataFrame, query: Callable[[SparkSession], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str,
    every: str = "300 milliseconds", once: bool = False
) -> StreamingQuery:
    """A live query: runs again when its table has changed, not more often than `every`, and publishes only results that differ from the
    last ones (by row count and the sum of row hashes). `once`: what is there now, then stop."""
    last: list = [None]

    def changed(batch: DataFrame, number: int) -> None:
        out = query(batch.sparkSession)
        mark = out.agg(F.count("*"), F.sum(F.xxhash64(*out.columns).cast("decimal(38,0)"))).first()
        if mark != last[0]:
            last[0] = mark
            publish(out, number)

    w = stream.writeStream.foreachBatch(changed).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def next_state(attempts_col: str = "attempts", ok_col: str = "ok", most: int = 3) -> dict[str, Column]:
    """State and attempts after one step: indexed if it went well, else one attempt more, failed with the last one."""
    n = F.col(attempts_col) + F.when(F.col(ok_col), 0).otherwise(1)
    return {"state": F.when(F.col(ok_col), INDEXED).when(n >= most, FAILED).otherwise(PENDING), attempts_col: n}


def outdated(records: DataFrame, version: int, column: str = "describe_version") -> DataFrame:
    """Indexed rows of an older model version."""
    return records.filter((F.col("state") == INDEXED) & (F.col(column) < version))

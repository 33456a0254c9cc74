"""The read side of the store: every query as a function of DataFrames. Column lists are left to the optimiser's pruning."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import day_label, month_label
from ..operators.classify import first_by_label
from ..operators.ranking import written
from ..sources.store import FAILED, INDEXED, PENDING


def newest(df: DataFrame, at: str = "taken_at", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(at), tie)


def in_category(records: DataFrame, category: str) -> DataFrame:
    return newest(records.filter(F.array_contains("categories", category)))


def favorites(records: DataFrame) -> DataFrame:
    return newest(records.filter("favorite"))


def collection_records(records: DataFrame, items: DataFrame, collection_id: int) -> DataFrame:
    """Records of one collection, latest addition first. The items are filtered before the join."""
    own = items.filter(F.col("collection_id") == collection_id).select(F.col("record_id").alias("id"), "added_at")
    return records.join(own, "id").orderBy(F.desc("added_at"), "id")


def category_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def category_order(records: DataFrame) -> DataFrame:
    return category_counts(records).orderBy(F.desc("n"), "category")


def collections(names: DataFrame, items: DataFrame, records: DataFrame) -> DataFrame:
    """Collections with the count of their items (also of records that are gone) and the newest record that is there."""
    counts = items.groupBy("collection_id").agg(F.count("*").alias("n"))
    cover = items.join(records.select(F.col("id").alias("record_id"), "uri"), "record_id").groupBy("collection_id").agg(
        F.max_by("uri", F.struct("added_at", "record_id")).alias("cover")
    )
    out = names.join(counts, names["id"] == counts["collection_id"], "left").drop("collection_id").join(
        cover, names["id"] == cover["collection_id"], "left"
    ).drop("collection_id")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def detail(records: DataFrame, names: DataFrame, items: DataFrame, wanted: DataFrame) -> DataFrame:
    """One record (wanted: a row with its id) with its keywords and the collections that it is in, by name, with their counts."""
    one = records.join(F.broadcast(wanted.select("id")), "id", "left_semi").withColumns(
        {
            "keywords": F.array_distinct(F.filter("objects", lambda x: x != "")),
            "description": F.when(F.trim("description") != "", F.col("description"))
        }
    )
    mine = items.join(F.broadcast(wanted.select(F.col("id").alias("record_id"))), "record_id", "left_semi").select("collection_id")
    counts = items.join(mine, "collection_id", "left_semi").groupBy("collection_id").agg(F.count("*").alias("n"))
    own = names.join(counts, names["id"] == counts["collection_id"]).select(F.struct("name", names["id"].alias("id"), "n").alias("c"))
    held = own.agg(F.array_sort(F.collect_list("c")).alias("collections"))  # those of one record
    return one.crossJoin(F.broadcast(held))


def counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("total"), F.count_if(F.col("state") == INDEXED).alias("indexed"), F.count_if(F.col("state") == PENDING).alias("pending"),
        F.count_if(F.col("state") == FAILED).alias("failed"), F.count_if(F.col("ocr_pending")).alias("ocr_pending"), F.count_if("favorite").alias("favorites"),
    )


def by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_semi")


def texts(records: DataFrame, described: bool) -> DataFrame:
    """(id, text): the texts of a record; missing ones leave their space."""
    parts = ["ocr_text", "note", "app", *["description"] * described]
    return records.select("id", F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in parts)).alias("text"))


def pending(records: DataFrame, limit: int, since=None) -> DataFrame:
    todo = records.filter(F.col("state") == PENDING)
    return newest(todo if since is None else todo.filter(F.col("taken_at") >= F.lit(since))).limit(limit)


def to_describe(records: DataFrame, limit: int, version: int, since=None) -> DataFrame:
    todo = records.filter((F.col("state") == INDEXED) & (F.col("describe_version") < version))
    return newest(todo if since is None else todo.filter(F.col("taken_at") >= F.lit(since))).limit(limit)


def taken_between(records: DataFrame, start, end) -> DataFrame:
    return newest(records.filter((F.col("taken_at") >= F.lit(start)) & (F.col("taken_at") < F.lit(end))))


def recent_searches(log: DataFrame, limit: int = 8) -> DataFrame:
    return log.orderBy(F.desc("at"), "query").limit(limit)


def app_labels(records: DataFrame) -> DataFrame:
    return records.filter("app is not null").groupBy("app").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "app")


def app_choices(labels: DataFrame, installed: DataFrame, extra: list[DataFrame]) -> DataFrame:
    """Labels in use (with an installed app's package, where its label is the same), then installed apps and further lists; each label once."""
    used = labels.join(installed.select("label", "package"), "label", "left").select("label", "package", "position")
    return first_by_label([used, installed.select("label", "package", "position"), *extra])


def by_day(records: DataFrame, today: date) -> DataFrame:
    """(day, label, n): records by day, the newest day first. What a day holds is by_day_items()."""
    day = F.to_date("taken_at")
    return records.groupBy(day.alias("day")).agg(F.count("*").alias("n")).withColumn("label", day_label(F.col("day"), today)).orderBy(F.desc("day"))


def by_day_items(records: DataFrame, today: date) -> DataFrame:
    """(day, label, id): the records of each day, newest first; rows, as a day may hold more than a list can."""
    day = F.to_date("taken_at")
    return newest(records.select(day.alias("day"), day_label(day, today).alias("label"), "id", "taken_at")).select("day", "label", "id")


def month_marks(records: DataFrame) -> DataFrame:
    """(index, label): where each month begins in the newest-first order. Positions come from counts of the newer months, so no window spans all records."""
    months = records.groupBy(F.trunc("taken_at", "month").alias("month")).agg(F.count("*").alias("n"))
    newer = Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each month
    return months.select(F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("index"), month_label(F.col("month")).alias("label"))


def mark_at(marks: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, label): the last mark at or before each target, else the first. Marks are a row a month: one sorted list of them goes to all
    targets, which needs no shuffle of these."""
    listed = marks.agg(F.array_sort(F.collect_list(F.struct("index", "label"))).alias("marks"))
    found = F.try_element_at(F.filter("marks", lambda m: m["index"] <= F.col("target")), F.lit(-1))["label"]
    some = F.exists("marks", lambda m: m["index"] <= F.col("target"))
    return targets.crossJoin(F.broadcast(listed)).select("target", F.when(some, found).otherwise(F.get("marks", F.lit(0))["label"]).alias("label"))


def as_of(targets: DataFrame, marks: DataFrame, at: str, tie: str, value: str) -> DataFrame:
    """targets with `value` and `mark_at` of the last mark at or before each one's `at` (null before the first mark); of marks at one place the
    one of largest `tie` counts. For marks of any number: both sides are sorted by ranges together and written, each range carries its last mark to
    its rows, and ranges that begin without one take it from those before. Nothing is broadcast but a row for each range, and equal places are
    split as well. targets and marks: their `at` has one type; marks have the columns at, tie and value."""
    rows = marks.filter(F.col(at).isNotNull()).select(
        F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).cast("string").alias("_tie"), F.struct(F.col(at).alias("mark_at"), F.col(value)).alias("_mark"),
        F.lit(None).cast(targets.select(F.struct("*")).schema[0].dataType).alias("_row"), F.col(tie).alias("_order")
    )
    own = targets.select(
        F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.xxhash64("*").cast("string").alias("_tie"), F.lit(None).cast(rows.schema["_mark"].dataType).alias("_mark"),
        F.struct("*").alias("_row"), F.lit(None).cast(rows.schema["_order"].dataType).alias("_order")
    )
    order = ["_at", "_kind", "_order", "_tie"]
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.unionByName(own).repartitionByRange(n, *order).sortWithinPartitions(*order)
    table = written(ranged.withColumn("_place", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_place", 33))
    ends = table.filter("_mark is not null").groupBy("_range").agg(F.max_by("_mark", "_place").alias("_last"))
    spots = table.select("_range").distinct().join(ends, "_range", "left")  # a row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = table.withColumn("_found", F.last("_mark", ignorenulls=True).over(within)).filter("_kind = 1")
    mark = F.coalesce("_found", "_carried")
    return found.join(F.broadcast(carried), "_range").select("_row.*", mark.getField("mark_at").alias("mark_at"), mark.getField(value).alias(value))


def launchable(apps: DataFrame, hidden: DataFrame) -> DataFrame:
    """Distinct apps (label, package) without the hidden packages, by name."""
    return apps.select("label", "package").distinct().join(hidden.select("package"), "package", "left_anti").orderBy(
        F.lower("label"), "label", "package"
    )


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def picker(choices: DataFrame, typed: str) -> DataFrame:
    return choices.filter(F.contains(F.lower("label"), F.lit(typed.strip().lower())))


def running_average(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, average): the running whole-number average (9 parts old, 1 part new; the first value starts it) in order of time, then value.
    Keys come together in that order and are folded as they pass, so a task holds one number, however long a key's history; nulls are
    passed over."""
    rows = events.select(key, F.col(at).alias("_at"), F.col(value).cast("long").alias("_value")).filter("_value is not null")
    ordered = rows.repartition(key).sortWithinPartitions(key, "_at", "_value").select(key, "_value")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, average, some = None, 0, False
        for b in batches:
            keys, averages = [], []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if some and k == last:
                    average = (average * 9 + v) // 10
                    continue
                if some:
                    keys.append(last)
                    averages.append(average)
                last, average, some = k, v, True
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(averages, pa.int64())], names=[key, "average"])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([last], b.column(0).type), pa.array([average], pa.int64())], names=[key, "average"])

    return ordered.mapInArrow(fold, f"`{key}` {ordered.schema[key].dataType.simpleString()}, average long")

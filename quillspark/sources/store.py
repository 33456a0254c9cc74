"""Reading and writing the store: media listings, synonym groups, entity JSON, checked files, Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dictionaries import CAPTURE_FOLDER
from ..operators.entities import TYPE as ENTITIES

#: One record of the store, with native arrays and timestamps in place of encoded text.
RECORDS_DDL = (
    "id long, uri string, name string, taken_at timestamp, width int, height int, size long, state int, attempts int, ocr_text string, note string, app string, "
    "app_source string, app_package string, page_url string, headline string, description string, categories array<string>, objects array<string>, "
    f"entities {ENTITIES}, favorite boolean, ocr_pending boolean, index_version int, describe_version int"
)
PENDING, INDEXED, FAILED = 0, 1, 2
GROUPS = "groups array<struct<id:string,kind:array<string>,words:array<struct<word:string,also:array<string>>>>>"


def captures(media: DataFrame) -> DataFrame:
    """Rows of a media listing (path, taken_ms, added_s, and more) that are pictures of a screen, newest addition first, with taken_at:
    when it was taken, or added if that is unknown."""
    like = F.coalesce(F.contains(F.col("path"), F.lit(CAPTURE_FOLDER)), F.lit(False))
    taken = F.when(F.col("taken_ms") > 0, F.col("taken_ms")).otherwise(F.col("added_s") * 1000)
    return media.filter(like).withColumn("taken_at", F.timestamp_millis(taken)).orderBy(F.desc("added_s"), "path")


def files(spark: SparkSession, path: str) -> DataFrame:
    """A folder's files as a media listing; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select(
        "path", F.lit(None).cast("long").alias("taken_ms"), F.unix_seconds("modificationTime").alias("added_s"), F.col("length").alias("size")
    )


def checked(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files with `ok`: whether the sha256 is the one of expected (name, size, sha256). Contents are read only where the size is right."""
    found = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    both = found.join(expected, "name")
    return both.select(
        "name", F.when(F.col("length") == F.col("size"), F.sha2("content", 256) == F.lower("sha256")).otherwise(F.lit(False)).alias("ok")
    )


def meanings(spark: SparkSession, path: str) -> DataFrame:
    """(name, meanings): keywords that a name stands for, of a JSON file of synonym groups; a word's other names stand for it, a group's
    kinds for all its words."""
    g = spark.read.schema(GROUPS).option("multiLine", "true").json(path).select(
        F.posexplode("groups").alias("g", "x")
    ).select("g", "x.kind", "x.words")
    w = g.select("g", "kind", F.posexplode("words").alias("w", "y")).select("g", "w", "kind", "y.word", "y.also")
    also = w.select("g", F.lit(0).alias("part"), "w", F.explode("also").alias("name"), "word")
    kind = w.select("g", F.lit(1).alias("part"), "w", F.explode("kind").alias("name"), "word")
    rows = also.unionByName(kind).withColumn("name", F.lower("name"))
    order = F.array_sort(F.collect_list(F.struct("g", "part", "w", "word")))  # a file of words
    return rows.groupBy("name").agg(order.alias("o")).select("name", F.array_distinct(F.transform("o", lambda x: x["word"])).alias("meanings"))


def encode_entities(entities: Column) -> Column:
    """Entities as JSON; keys without a value are left out, false times too."""
    short = F.transform(
        entities,
        lambda e: F.struct(
            e["type"].alias("t"), e["text"].alias("x"), e["value"].alias("v"), e["epoch_millis"].alias("e"), F.when(e["has_time"], True).alias("h")
        )
    )
    return F.to_json(short)


def decode_entities(json: Column) -> Column:
    """The entities of encode_entities(); malformed text is an empty list."""
    short = F.from_json(json, "array<struct<t:string,x:string,v:string,e:long,h:boolean>>", {"mode": "PERMISSIVE"})
    full = F.transform(
        F.filter(short, lambda e: e["t"].isNotNull()),
        lambda e: F.struct(
            e["t"].alias("type"), e["x"].alias("text"), e["v"].alias("value"), e["e"].alias("epoch_millis"),
            F.coalesce(e["h"], F.lit(False)).alias("has_time")
        )
    )
    return F.coalesce(full, F.array().cast(ENTITIES))


def encode_list(values: Column) -> Column:
    """`,a,b,` as older tables have lists; empty lists are the empty text."""
    return F.when(F.size(values) > 0, F.concat(F.lit(","), F.array_join(values, ","), F.lit(","))).otherwise("")


def decode_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def upgrade(old: DataFrame) -> DataFrame:
    """A table of an older layout in the present one: lists decoded, the category `people` gone, missing columns with their defaults, millisecond times as timestamps."""
    df = old
    for c in ("categories", "objects"):
        if dict(df.dtypes).get(c) == "string":
            df = df.withColumn(c, decode_list(F.col(c)))
    if "categories" in df.columns:
        df = df.withColumn("categories", F.array_remove("categories", "people"))
    if dict(df.dtypes).get("entities") == "string":
        df = df.withColumn("entities", decode_entities(F.col("entities")))
    if dict(df.dtypes).get("taken_at") == "bigint":
        df = df.withColumn("taken_at", F.timestamp_millis("taken_at"))
    defaults = {
        "state": F.lit(PENDING), "attempts": F.lit(0), "favorite": F.lit(False), "ocr_pending": F.lit(False), "index_version": F.lit(0),
        "describe_version": F.lit(0), "categories": F.array(), "objects": F.array(), "entities": F.array()
    }
    out = []
    for f in T.StructType.fromDDL(RECORDS_DDL):
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else defaults.get(f.name, F.lit(None)).cast(f.dataType)
        out.append((F.coalesce(c, defaults[f.name].cast(f.dataType)) if f.name in defaults else c).alias(f.name))
    return df.select(*out)


def write(df: DataFrame, path: str, by: str | None = "taken_at") -> None:
    """A Parquet table; sorted within files by time, so that range queries skip row groups."""
    (df.sortWithinPartitions(by) if by else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

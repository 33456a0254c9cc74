"""The write side: every change as a function from tables to tables. Nothing is changed in place; a caller writes what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index, first_generation
from ..sources.store import FAILED, INDEXED, PENDING
from ..sources.versions import Version, Versions


def only_in(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def sync(records: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, added, removed): new rows of the listing come in as they are, rows that it lacks go, rows that are there stay unchanged."""
    added, removed = only_in(listing, records), only_in(records, listing)
    return records.join(listing.select("id"), "id", "left_semi").unionByName(added, allowMissingColumns=True), added, removed


def cascade_delete(gone: DataFrame, items: DataFrame) -> DataFrame:
    """Items without those of the records that are gone."""
    return items.join(gone.select(F.col("id").alias("record_id")), "record_id", "left_anti")


def update(records: DataFrame, changes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """records with new values where changes has the id; the values see both rows (a change's columns as new_<name>)."""
    new = changes.select(F.col("id"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"new_{c}") for c in changes.columns if c != "id"))
    both = records.join(new, "id", "left")
    return both.select(*(F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in records.columns))


def save_analysis(records: DataFrame, analysis: DataFrame, version: int) -> DataFrame:
    """Results of the analysis (id, ocr_text, app, app_source, app_package, page_url, headline, categories, entities). A name that the user
    gave stays, one from usage gives way to one from usage only."""
    keep = F.coalesce(
        (F.col("app_source") == "user") | ((F.col("app_source") == "usage") & ~F.coalesce(F.col("new_app_source") == "usage", F.lit(False))),
        F.lit(False)
    )
    values = {c: F.col(f"new_{c}") for c in ("ocr_text", "page_url", "headline", "categories", "entities")}
    values |= {c: F.when(keep, F.col(c)).otherwise(F.col(f"new_{c}")) for c in ("app", "app_source", "app_package")}
    values |= {"state": F.lit(INDEXED), "index_version": F.lit(version), "ocr_pending": F.lit(False)}
    return update(records, analysis, values)


def mark_failed(records: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    """One attempt more; with the last one a record counts as failed."""
    n = F.col("attempts") + 1
    return update(records, failed.select("id"), {"attempts": n, "state": F.when(n >= most, FAILED).otherwise(PENDING)})


def requeue(records: DataFrame, only_ocr_pending: bool = False) -> DataFrame:
    hit = F.col("ocr_pending") if only_ocr_pending else F.lit(True)
    return records.withColumns({"state": F.when(hit, PENDING).otherwise(F.col("state")), "attempts": F.when(hit, 0).otherwise(F.col("attempts"))})


def save_description(records: DataFrame, described: DataFrame, version: int) -> DataFrame:
    """Descriptions (id, description, objects, categories); blank ones are null, null categories change nothing."""
    text = F.col("new_description")
    return update(
        records, described,
        {
            "description": F.when(F.trim(text) != "", text), "objects": F.coalesce("new_objects", F.array().cast("array<string>")),
            "categories": F.coalesce("new_categories", "categories"), "describe_version": F.lit(version)
        }
    )


def add_recent(log: DataFrame, new: DataFrame, most: int = 20) -> DataFrame:
    """The search log (query, at) with new searches of two characters or more; each query once, at its latest time; the newest `most` stay."""
    fresh = new.select(F.trim("query").alias("query"), "at").filter(F.length("query") >= 2)
    return log.select("query", "at").unionByName(fresh).groupBy("query").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "query").limit(most)


def add_to_collection(items: DataFrame, new: DataFrame) -> DataFrame:
    """items with new ones (collection_id, record_id, added_at); those that are there stay as they are."""
    keys = ["collection_id", "record_id"]
    return items.unionByName(new.groupBy(*keys).agg(F.min("added_at").alias("added_at")).join(items.select(*keys), keys, "left_anti"))


def remove_from_collection(items: DataFrame, gone: DataFrame) -> DataFrame:
    return items.join(gone.select("collection_id", "record_id"), ["collection_id", "record_id"], "left_anti")


def set_note(records: DataFrame, notes: DataFrame) -> DataFrame:
    return update(records, notes, {"note": F.when(F.col("new_note") != "", F.col("new_note"))})


def toggle_favorite(records: DataFrame, ids: DataFrame) -> DataFrame:
    return update(records, ids.select("id"), {"favorite": ~F.col("favorite")})


def set_app(records: DataFrame, apps: DataFrame) -> DataFrame:
    return update(records, apps, {"app": F.col("new_app"), "app_package": F.col("new_app_package"), "app_source": F.lit("user")})


def rename_collection(names: DataFrame, collection_id: int, name: str) -> DataFrame:
    return names.withColumn("name", F.when(F.col("id") == collection_id, name.strip()).otherwise(F.col("name")))


def delete_collection(names: DataFrame, items: DataFrame, collection_id: int) -> tuple[DataFrame, DataFrame]:
    return names.filter(F.col("id") != collection_id), items.filter(F.col("collection_id") != collection_id)


def forget(records: DataFrame, items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return only_in(records, ids), cascade_delete(ids, items)


def search_rows(records: DataFrame) -> DataFrame:
    """Records as the index takes them: what the user and the app say of them counts most, then descriptions, then their texts."""
    says = F.concat_ws(" ", "app", "headline", "note", F.array_join("objects", " "))
    return records.select("id", "taken_at", says.alias("strong"), F.col("description").alias("described"), F.col("ocr_text").alias("body"))


def found_store(store: Versions, records: DataFrame, items: DataFrame, grams: bool = True) -> Version:
    """A new store: records, items of collections and the index of the records, published at once."""
    folders = {"records": [store.write("records", records)], "items": [store.write("items", items)]}
    return store.publish(store.current(), folders | first_generation(store, search_rows(records), grams))


def sync_store(store: Versions, listing: DataFrame) -> tuple[Version, DataFrame, DataFrame]:
    """(version, added, removed): the store after sync() with a listing. Records, items and index change together: a reader
    has all three as they were or as they are, and a change that fails, or was overtaken, leaves them as they were. Of the index only the
    rows of what came and went are written."""
    seen = store.current()
    after, added, removed = sync(seen.read("records"), listing)
    folders = {"records": [store.write("records", after)], "items": [store.write("items", cascade_delete(removed, seen.read("items")))]}
    whole = seen.read("records").limit(0).unionByName(added, allowMissingColumns=True)
    folders |= Index(store, seen).delta(search_rows(whole), removed.select("id"))
    return store.publish(seen, seen.folders | folders), added, removed

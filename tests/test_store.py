import hashlib
import json
from datetime import date, datetime

from pyspark.sql import functions as F

from quillspark.functions.dictionaries import CAPTURE_FOLDER
from quillspark.plans import reads, writes
from quillspark.sources import store
from quillspark.streaming import live


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_collections_count_items_whose_record_is_gone(spark):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    items = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (1, 99, 7), (2, 98, 1)], "collection_id long, record_id long, added_at long")
    recs = spark.createDataFrame(
        [(10, "u10", ["x", "", "x"], " "), (11, "u11", [], "d")], "id long, uri string, objects array<string>, description string"
    )
    assert rows(reads.collections(names, items, recs), "id", "n", "cover") == sorted([(1, 3, "u11"), (2, 1, None), (3, 0, None)], key=lambda x: x[0])
    d = reads.detail(recs, names, items, spark.createDataFrame([(10,)], "id long")).first()
    assert d["keywords"] == ["x"] and d["description"] is None and [tuple(c) for c in d["collections"]] == [("a", 1, 3)]
    assert [r["id"] for r in reads.collection_records(recs, items, 1).collect()] == [11, 10]


def test_sync_inserts_and_deletes_but_never_updates(spark):
    have = spark.createDataFrame([(1, "old"), (2, "gone")], "id long, name string")
    listing = spark.createDataFrame([(1, "new"), (3, "added")], "id long, name string")
    after, added, removed = writes.sync(have, listing)
    assert rows(after) == [(1, "old"), (3, "added")] and rows(added, "id") == [(3,)] and rows(removed, "id") == [(2,)]


def test_attempts_and_states(spark):
    r = spark.createDataFrame([(1, 0, 0), (2, 0, 2), (3, 1, 0)], "id long, state int, attempts int")
    assert rows(writes.mark_failed(r, spark.createDataFrame([(1,), (2,)], "id long"))) == [(1, 0, 1), (2, 2, 3), (3, 1, 0)]


def test_analysis_keeps_names_that_the_user_gave(spark):
    r = spark.createDataFrame(
        [(1, "Mine", "user"), (2, "Used", "usage"), (3, "Used", "usage"), (4, None, None)], "id long, app string, app_source string"
    )
    blank = {
        c: F.lit(None).cast(t)
        for c, t in {
            "ocr_text": "string", "app_package": "string", "page_url": "string", "headline": "string", "categories": "array<string>",
            "entities": "string", "state": "int", "index_version": "int", "ocr_pending": "boolean"
        }.items()
    }
    r = r.withColumns(blank)
    new = spark.createDataFrame([(1, "N", "text"), (2, "N", "text"), (3, "N", "usage"), (4, "N", None)], "id long, app string, app_source string").withColumns(
        {c: v for c, v in blank.items() if c not in ("state", "index_version", "ocr_pending")}
    )
    assert rows(writes.save_analysis(r, new, 1), "id", "app", "state") == [(1, "Mine", 1), (2, "Used", 1), (3, "N", 1), (4, "N", 1)]


def test_recent_searches(spark):
    log = spark.createDataFrame([(f"q{k:02}", k) for k in range(20)], "query string, at long")
    new = spark.createDataFrame([(" q03 ", 50), ("x", 60), ("new", 55)], "query string, at long")
    got = writes.add_recent(log, new).collect()
    assert [r["query"] for r in got][:3] == ["new", "q03", "q19"] and len(got) == 20 and "q00" not in {r["query"] for r in got}
    assert [r["query"] for r in reads.recent_searches(writes.add_recent(log, new)).collect()][:2] == ["new", "q03"]


def test_lists_json_and_upgrade(spark):
    df = spark.createDataFrame(
        [(1, ",a,people,b,", "[{\"t\":\"URL\",\"x\":\"u\",\"v\":\"w\"}]", 1000), (2, "", "{bad", None)],
        "id long, categories string, entities string, taken_at long"
    )
    up = store.upgrade(df).orderBy("id").collect()
    assert up[0]["categories"] == ["a", "b"] and up[0]["taken_at"] == datetime(1970, 1, 1, 0, 0, 1) and tuple(up[0]["entities"][0]) == (
        "URL", "u", "w", None, False
    )
    assert up[1]["categories"] == [] and up[1]["entities"] == [] and up[1]["state"] == 0
    lists = spark.createDataFrame([(["a", "b"],), ([],)], "l array<string>").select(store.encode_list(F.col("l")).alias("t"))
    assert [r[0] for r in lists.collect()] == [",a,b,", ""]
    assert [r[0] for r in lists.select(store.decode_list(F.col("t"))).collect()] == [["a", "b"], []]


def test_days_marks_and_averages(spark):
    df = spark.createDataFrame(
        [(1, datetime(2026, 10, 3, 5)), (2, datetime(2026, 10, 2)), (3, datetime(2026, 9, 1)), (4, datetime(2025, 9, 1))],
        "id long, taken_at timestamp"
    )
    assert [r["label"] for r in reads.by_day(df, date(2026, 10, 3)).collect()] == ["Today", "Yesterday", "Tue, 1 Sep", "1 Sep 2025"]
    marks = reads.month_marks(df)
    targets = spark.createDataFrame([(0,), (1,), (2,), (9,)], "target long")
    assert rows(reads.mark_at(marks, targets)) == [(0, "October 2026"), (1, "October 2026"), (2, "September 2026"), (9, "September 2025")]
    e = spark.createDataFrame([("k", 1, 100), ("k", 2, 200), ("k", 3, 50), ("j", 1, 7)], "k string, at long, v long")
    assert rows(reads.running_average(e, "k", "at", "v")) == [("j", 7), ("k", 104)]


def test_choices_and_words(spark):
    lab = spark.createDataFrame([("chrome", 1), ("Zed", 2)], "label string, position long")
    inst = spark.createDataFrame([("Chrome", "p.c", 1), ("Maps", "p.m", 2)], "label string, package string, position long")
    assert rows(reads.app_choices(lab, inst, []), "label") == [("Maps",), ("Zed",), ("chrome",)]
    assert [r[0] for r in spark.createDataFrame([(" a  b\n",), ("",)], "t string").select(reads.word_count(F.col("t"))).collect()] == [2, 0]


def test_sources(spark, tmp_path):
    media = spark.createDataFrame(
        [(f"/DCIM/{CAPTURE_FOLDER}/a.png", 0, 5), (f"/x/{CAPTURE_FOLDER}_1.png", 9000, 6), ("/x/b.png", 1, 7), (None, 1, 1)],
        "path string, taken_ms long, added_s long"
    )
    got = store.captures(media).collect()
    assert [r["path"] for r in got] == [f"/x/{CAPTURE_FOLDER}_1.png", f"/DCIM/{CAPTURE_FOLDER}/a.png"] and got[1]["taken_at"] == datetime(1970, 1, 1, 0, 0, 5)
    f = tmp_path / "words.json"
    f.write_text(
        json.dumps({"groups": [{"id": "g", "kind": ["Food"], "words": [{"word": "pizza", "also": []}, {"word": "tea", "also": ["chai"]}]}]}, indent=1)
    )
    assert {r["name"]: r["meanings"] for r in store.meanings(spark, str(f)).collect()} == {"food": ["pizza", "tea"], "chai": ["tea"]}
    data = f.read_bytes()
    want = spark.createDataFrame([("words.json", len(data), hashlib.sha256(data).hexdigest())], "name string, size long, sha256 string")
    assert store.checked(spark, str(tmp_path), want).first()["ok"]
    assert not store.checked(spark, str(tmp_path), want.withColumn("size", F.lit(1).cast("long"))).first()["ok"]
    assert store.files(spark, str(tmp_path)).count() == 1
    df = spark.createDataFrame([(1, datetime(2026, 1, 1))], "id long, taken_at timestamp")
    store.write(df, str(tmp_path / "t"))
    assert rows(store.read(spark, str(tmp_path / "t")), "id") == [(1,)]


def test_streams(spark, tmp_path):
    src, seen, shown = str(tmp_path / "in"), [], []
    for k in range(6):
        spark.createDataFrame([(k, 0)], "id long, attempts int").write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    q = live.drain(live.arrivals(spark, src, schema, 4), lambda df, n: seen.append(df.count()), str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert sum(seen) == 6 and max(seen) <= 4
    q = live.follow(
        live.arrivals(spark, src, schema, 2),
        lambda s: s.read.parquet(src).agg(F.count("*").alias("n")), lambda df, n: shown.append(df.first()["n"]), str(tmp_path / "c2"), once=True
    )
    q.awaitTermination(60)
    assert shown == [6]
    r = spark.createDataFrame([(1, 0, True), (2, 1, False), (3, 2, False)], "id long, attempts int, ok boolean").withColumns(live.next_state())
    assert rows(r, "id", "state") == [(1, 1), (2, 0), (3, 2)]

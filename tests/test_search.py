from datetime import date, datetime

from pyspark.sql import functions as F

from quillspark.functions.text import query_terms
from quillspark.operators import search
from quillspark.operators.ranking import numbered

SCHEMA = "id long, strong string, described string, body string, taken_at timestamp, categories array<string>"


def docs(spark, *rows):
    return spark.createDataFrame([(i, s, d, b, datetime(2026, 9, t), c) for i, s, d, b, t, c in rows], SCHEMA)


def tiers(df):
    got = df.orderBy("tier", "rank").collect()
    return [r["id"] for r in got if r["tier"] == "best"], [r["id"] for r in got if r["tier"] == "more"]


def test_strong_matches_come_first(spark):
    df = docs(
        spark, (1, "Zomato", "", "Order placed · Biryani", 10, []), (2, "WhatsApp Rahul", "", "lets order from zomato tonight", 30, []),
        (3, "Zomato Gold", "", "zomato zomato", 20, []), (4, "Chrome", "", "zomatoes are not tomatoes", 28, [])
    )
    assert tiers(search.rank(df, query_terms("zomato"))) == ([3, 1], [2])
    assert {r[0] for r in search.match(df, query_terms("zomato")).select("id").collect()} == {1, 2, 3}
    assert {r[0] for r in search.match_by_tokens(search.token_table(df), query_terms("zomato")).collect()} == {1, 2, 3}


def test_every_word_must_match_and_phrases_count_more(spark):
    df = docs(
        spark, (1, "", "", "6x08 - Red John\n5x22 - Red John's Rules", 1, []), (2, "", "", "Red Dawn\nJohn Wick", 1, []),
        (3, "", None, "The Red Barn", 1, [])
    )
    assert tiers(search.rank(df, query_terms("red john"))) == ([1], [2])
    df = docs(spark, (1, "", "", "red shoes sale today", 1, []), (2, "", "A pair of red shoes", "", 1, []), (3, "red shoes", "", "", 1, []))
    best, more = tiers(search.rank(df, query_terms("red shoes")))
    assert best + more == [3, 2, 1]
    assert search.rank(df, []).count() == 0


def test_cascade_takes_the_first_stage_with_rows(spark):
    df = docs(spark, (1, "", "", "zomatoes", 1, []), (2, "", "", "a zomato", 2, []), (3, "", "", "xzoma", 3, []))
    stage = lambda q: {(r["id"], r["stage"]) for r in search.cascade(df, q).collect()}
    assert stage("zomato") == {(2, 1)}
    assert stage("zom") == {(1, 2), (2, 2)}
    assert stage("xzo") == {(3, 2)}
    assert stage("zoma") == {(1, 2), (2, 2)}
    assert stage("mato") == {(1, 3), (2, 3)}
    assert stage("  ") == set()


def test_search_combines_dates_categories_and_texts(spark):
    df = docs(spark, (1, "", "", "my movies list", 1, ["movies"]), (2, "", "", "movies movies", 29, ["food"]), (3, "", "", "none", 30, ["movies"]))
    got = [(r["id"], r["reason"]) for r in search.search(df, "movies", date(2026, 10, 3)).orderBy("rank").collect()]
    assert got == [(3, "CATEGORY"), (1, "CATEGORY"), (2, "TEXT")]
    got = [(r["id"], r["reason"], r["snippet"]) for r in search.search(df, "list september 2026", date(2026, 10, 3)).collect()]
    assert got == [(1, "TEXT", "my movies list")]
    assert [r["id"] for r in search.search(df, "this week", date(2026, 10, 3)).orderBy("rank").collect()] == [3, 2]


def test_snippet(spark):
    text = "Your order of Margherita Pizza from Domino's has been delivered. Rate your experience."
    df = spark.createDataFrame([(text,), ("no hit",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(search.snippet(F.col("t"), ["domino"], 30)).collect()]
    assert got == ["…order of Margherita Pizza from Domino's has been delivered. Rate…", None, None, None]


def test_like_escapes_nothing(spark):
    df = docs(spark, (1, "", "", "100% off_now", 1, []), (2, "", "", "100 off", 2, []))
    assert [r["id"] for r in search.like(df, "0% OFF_").collect()] == [1]


def test_snippet_stops_at_a_line_end(spark):
    text = "x" * 10 + " first line here.\n" + "y" * 29 + " domino"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(search.snippet(F.col("t"), ["domino"], 30)).first()[0] == "…" + "y" * 29 + " domino"


def test_phrases_match_by_tokens(spark):
    df = docs(
        spark, (1, "", "", "a red shoe box", 1, []), (2, "red", "", "shoe", 2, []), (3, "", "", "shoe red", 3, []), (4, "", "", "sneakers", 4, [])
    )
    terms = [("trainers", ["red shoe", "sneakers"])]
    assert {r[0] for r in search.match_by_tokens(search.token_table(df), terms).collect()} == {1, 4}


def test_ranks_over_many_ranges(spark):
    df = spark.range(1000).select(
        "id", (F.col("id") % 7).cast("float").alias("score"), F.when(F.col("id") % 3 == 0, "best").otherwise("more").alias("tier")
    )
    got = {r["id"]: (r["tier"], r["rank"]) for r in numbered(df, "tier", F.desc("score"), F.asc("id")).collect()}
    for tier in ("best", "more"):
        own = sorted((i for i in got if got[i][0] == tier), key=lambda i: (-(i % 7), i))
        assert [got[i][1] for i in own] == list(range(1, len(own) + 1))


def test_diacritics_fold_where_asked(spark):
    df = docs(spark, (1, "", "", "Caf\u00e9 noir", 1, []), (2, "", "", "caf\u00e9teria", 2, []), (3, "", "", "coffee", 3, []))
    found = lambda **o: {(r["id"], r["stage"]) for r in search.cascade(df, "cafe", **o).collect()}
    assert found(fold_diacritics=True) == {(1, 2), (2, 2)}
    assert found() == set()
    assert {r["id"] for r in search.prefix_match(df, ["no\u00eer"], fold_diacritics=True).collect()} == {1}
    assert {r["id"] for r in search.candidates(df, query_terms("cafe"), fold_diacritics=True).collect()} == {1, 2}

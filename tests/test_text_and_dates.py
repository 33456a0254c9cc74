from datetime import date, datetime

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.dates import parse_query
from quillspark.operators.search import category_query

TODAY = date(2026, 10, 3)


def test_forms_of_words():
    assert tx.forms("berries") == ["berries", "berry"]
    assert tx.forms("box") == ["box", "boxes"]
    assert tx.forms("glass") == ["glass", "glasses"]
    assert tx.forms("2026") == ["2026"]
    assert tx.word_expression("Cars bike") == "cars OR car bike OR bikes"
    assert tx.prefix_expression("Movie Tick") == "movie tick*"
    assert tx.prefix_expression("नमस्ते") == "नमस्ते*"
    assert tx.prefix_expression("  ?? ") is None


def test_terms_drop_filler_unless_there_is_nothing_else():
    terms = tx.query_terms("show me photos of a motorcycle on the beach", {"motorcycle": ["bike"]})
    assert tx.match_expression(terms) == "motorcycle OR motorcycles OR bike beach OR beaches"
    assert tx.match_expression(tx.query_terms("auto", {"auto": ["auto rickshaw"]})) == 'auto OR autos OR "auto rickshaw"'
    assert [w for w, _ in tx.query_terms("photos")] == ["photos"]
    assert tx.match_expression([]) is None


def test_word_hits(spark):
    df = spark.createDataFrame([("A red car next to two cars",), ("Oscar rides a motorbike past the cart",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.word_hits(F.col("t"), ["car"])).collect()][:2] == [2, 0]


def test_occurrences_share_separators(spark):
    df = spark.createDataFrame([("zomato zomato, Zomato!",), ("ice cream ice cream",), ("",)], "t string")
    p = tx.padded(F.col("t"))
    rows = df.select(tx.occurrences(p, "zomato"), tx.occurrences(p, "ice cream"), tx.has(p, "ice cream")).collect()
    assert [tuple(r) for r in rows] == [(3, 0, False), (0, 2, True), (0, 0, False)]


def test_cleaning(spark):
    assert tx.basic_clean("  ﬁsh &amp;amp; ‘chips’\r\nＡ　B\u0000 &#233;&#xD800; &nope; ") == "fish & 'chips'\nA B é� &nope;"
    assert tx.fix_text("é") == "é"
    df = spark.createDataFrame([("&lt;b&gt; &amp;lt; &euro;",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.unescape_named(F.col("t"))).collect()] == ["<b> &lt; €", None]
    assert [r[0] for r in df.select(tx.unescape_col("t")).collect()] == ["<b> &lt; €", None]


def test_date_queries():
    d = lambda *x: datetime(*x)
    assert parse_query("beach photos 2024", TODAY) == ((d(2024, 1, 1), d(2025, 1, 1), "2024"), "beach photos")
    assert parse_query("dogs in june 2023", TODAY) == ((d(2023, 6, 1), d(2023, 7, 1), "June 2023"), "dogs")
    assert parse_query("december", TODAY)[0][0] == d(2025, 12, 1)
    assert parse_query("aug", TODAY)[0][0] == d(2026, 8, 1)
    assert parse_query("food last week", TODAY) == ((d(2026, 9, 21), d(2026, 9, 28), "Last week"), "food")
    assert parse_query("yesterday", TODAY)[0][0] == d(2026, 10, 2)
    assert parse_query("red car", TODAY) == (None, "red car")


def test_category_queries():
    assert category_query("movies") == ["movies"]
    assert category_query("upi receipt") == ["payments"]
    assert category_query("my chats") == ["chats"]
    assert category_query("Shopping") == ["shopping"]
    for q in ("blue car parked near a mountain at sunset", "shoes", "red shoes", "shopping shoes", "whatsapp", ""):
        assert category_query(q) == []

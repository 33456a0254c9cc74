import hashlib
from datetime import date
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import captions, classify, layout
from quillspark.operators.entities import entities, phones, with_entities
from quillspark.plans import queries as own
from quillspark.plans.enrich import enrich

TODAY, UTC = date(2026, 10, 3), ZoneInfo("UTC")


def of(text, kind):
    return [e[2] for e in entities(text, TODAY, UTC) if e[0] == kind]


def test_entities():
    assert of("Pay to rahul.k@okhdfcbank or 9876543210@ybl", "UPI") == ["rahul.k@okhdfcbank", "9876543210@ybl"]
    assert of("Pay to rahul.k@okhdfcbank", "EMAIL") == []
    assert of("Mail support@swiggy.in", "EMAIL") == ["support@swiggy.in"]
    got = of("Call +91 98765 43210 or 08765-43210? Also 1800 123 4567", "PHONE")
    assert "+919876543210" in got and "18001234567" in got
    assert of("Order total 12345678901234", "PHONE") == []
    assert of("Paid ₹1,499.00 to Swiggy. MRP Rs. 2,999 and 450/-", "AMOUNT") == ["₹1499.00", "₹2999", "₹450"]
    assert of("Visit https://example.com/a?b=1, or www.irctc.co.in. Also amazon.in/deals", "URL") == [
        "https://example.com/a?b=1", "https://www.irctc.co.in", "https://amazon.in/deals"
    ]
    assert of("Mail me at a@b.com", "URL") == []
    assert of("482913 is your OTP? No: Your OTP is 482913. Do not share", "CODE") == ["482913"]


def test_dates():
    assert of("Show on 12 Oct 2026, 7:30 PM at PVR", "DATE") == ["2026-10-12T19:30"]
    assert of("Departs Mar 5 at 6 am", "DATE") == ["2027-03-05T06:00"]
    assert of("Valid till 03/11/2026", "DATE") == ["2026-11-03"]
    assert of("Date: 2026-12-25", "DATE") == ["2026-12-25"]
    assert of("Delivered 29 Sep, 5 items", "DATE") == ["2026-09-29"]
    assert of("on 31/02/2026", "DATE") == []


def test_entities_as_a_column(spark):
    df = spark.createDataFrame([("Mail a@b.co, see bc.co/x",), ("nothing",), (None,)], "t string")
    got = [[e["value"] for e in r["entities"]] for r in with_entities(df, "t", TODAY).collect()]
    assert got == [["a@b.co", "https://bc.co/x"], [], []]
    df = spark.createDataFrame([("+1 (437) 555-0689 and +1 (437) 555-0689",)], "t string")
    assert df.select(phones(F.col("t"))).first()[0] == ["+14375550689"]


def test_keywords_and_categories(spark):
    df = spark.createDataFrame([("new ott release",), ("water bottle",), ("add to cart now",)], "t string")
    assert [tuple(r) for r in df.select(classify.contains_keyword(F.col("t"), "ott"), classify.contains_keyword(F.col("t"), "add to cart")).collect()] == [
        (True, False), (False, False), (False, True)
    ]
    df = spark.createDataFrame(
        [("Buy now, wishlist", "Motorola"), ("trailer of the season", "Ola"), ("x", None), (None, "WhatsApp")], "t string, a string"
    )
    assert [r[0] for r in df.select(classify.classify(F.col("t"), F.col("a"))).collect()] == [["shopping"], ["travel", "movies"], [], ["chats"]]
    assert df.select(classify.categories_of_app(F.lit("WhatsApp"))).first()[0] == ["chats"]


def test_app_hints(spark):
    texts = [
        ("ggml-org\nllama.cpp\n98.2k stars 14.9k forks\nIssues 412\nPull requests 530", "GitHub"),
        ("Priya Nair • 2nd\nSenior Android Engineer\nLike Comment Repost Send", "LinkedIn"),
        ("82%\nFriday, 3 October\n7:41\nInstagram · now\nrahul_99 liked your photo.", "Lock screen"),
        ("google.com/search?q=ram\nAll Shopping Images Videos News\nAmazon.in\nPeople also ask", "Google"),
    ]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [r[0][0] for r in df.select(classify.app_candidates(F.col("t"))).collect()] == [a for _, a in texts]
    best = {
        "5:08\nr/TheMentalist\n4x24 - The Crimson Hat\nSeason 5\n6x08 - Red John\nJoin the conversation": "Reddit",
        "Rahul\nonline\nMessages and calls are end-to-end encrypted\nType a message": "WhatsApp", "Chats\nUpdates\nCommunities\nCalls\nArchived": "WhatsApp",
        "82%\nFriday, 3 October\n7:41": "Lock screen", "Known issues with the update": None, "₹120 per/hour, install charges extra": None, "": None,
        "Amazon.in · https://www.amazon.in\nBuy 8GB RAM Laptops at Amazon.in": None,
    }
    df = spark.createDataFrame([(t,) for t in best], "t string")
    assert [r[0] for r in df.select(classify.app_of_text(F.col("t"))).collect()] == list(best.values())


def test_app_names(spark):
    installed = spark.createDataFrame(
        [
            (n, f"pkg.{n}", k)
            for k, n in enumerate(
                ["Chrome", "Google", "Google Pay", "WhatsApp Business", "Amazon Shopping", "X", "Maps", "GitHub", "Instagram", "Photos"]
            )
        ],
        "label string, package string, position long"
    )
    want = {
        "Google Chrome": "Chrome", "GPay": "Google Pay", "Twitter": "X", "Google Maps": "Maps", "Google Photos": "Photos",
        "WhatsApp": "WhatsApp Business", "Amazon": "Amazon Shopping", "github": "GitHub", "Lock Screen": "Lock screen", "home screen": "Home screen",
        "Llama.cpp": None, "Jack & Jones": None, "Zepto": None, "": None, "Go": None
    }
    answers = spark.createDataFrame(list(enumerate(want)), "id int, answer string")
    assert {r["answer"]: r["label"] for r in classify.match_apps(answers, installed).collect()} == want


def test_file_names(spark):
    want = {
        "Capture_20240229_103000_YouTube.jpg": ("YouTube", None), "Capture_20240229-103000_Chrome.png": ("Chrome", None), "Capture_20240229_103000_Samsung Experience Home.jpg": (
            "Samsung Experience Home", None
        ),
        "Capture_2024-02-29-10-30-00-123_com.google.android.youtube.jpg": (
            None, "com.google.android.youtube"
        ), "Capture_20240229-103000.png": None, "IMG_20240229_103000.jpg": None,
    }
    df = spark.createDataFrame([(n,) for n in want], "n string")
    got = [r[0] and tuple(r[0]) for r in df.select(classify.app_of_file_name(F.col("n"))).collect()]
    assert got == list(want.values())
    df = spark.createDataFrame([("com.google.android.youtube",), ("com.example.android",), ("com.android",)], "p string")
    assert [r[0] for r in df.select(classify.label_of_package(F.col("p"))).collect()] == ["YouTube", "Example", "Com.android"]
    assert spark.range(1).select(
        classify.is_browser(F.lit("Chrome"), F.lit(None).cast("string")),
        classify.is_browser(F.lit(None).cast("string"), F.lit("org.mozilla.firefox")), classify.is_browser(F.lit("Maps"), F.lit("x"))
    ).first()[:] == (True, True, False)


LINES = "lines array<struct<text:string,top:float,bottom:float,left:float>>, browser boolean"


def test_page_links(spark):
    bar = [
        ("12:12", 0.01, 0.03, 0.0), ("🔒 nothing.community/d/61761-nothing-os-50-open-beta ⋮", 0.05, 0.08, 0.0), ("NOS 5.0 Open Beta", 0.3, 0.33, 0.0)
    ]
    df = spark.createDataFrame(
        [
            (bar, True), (bar, False), ([("Paid to rahul@okhdfcbank", 0.05, 0.08, 0.0)], True), ([("version 5.0.1", 0.05, 0.08, 0.0)], True),
            ([], True)
        ],
        LINES
    )
    assert [r[0] for r in df.select(layout.page_link(F.col("lines"), F.col("browser"))).collect()] == [
        "https://nothing.community/d/61761-nothing-os-50-open-beta", None, None, None, None
    ]
    assert spark.range(1).select(
        layout.page_link_of_text(F.lit("11:15\ngoogle.com/search?q=8gb+ram+laptop\nGoogle\n8gb ram laptop"))
    ).first()[0] == "https://google.com/search?q=8gb+ram+laptop"


def test_headlines_and_reading_order(spark):
    lines = [
        ("5:08", 0.01, 0.04, 0.0), ("Red-Themed The Mentalist Episodes List", 0.20, 0.26, 0.0), ("Oct 03, 2026 · 07:38 AM", 0.29, 0.31, 0.0),
        ("A Reddit post in r/TheMentalist lists episodes", 0.40, 0.42, 0.0), ("from seasons 4-6 that feature the word Red", 0.43, 0.45, 0.0),
        ("Notes", 0.70, 0.72, 0.0)
    ]
    df = spark.createDataFrame([(lines, True), (lines[2:], True), (lines[:1], True)], LINES)
    assert [r[0] for r in df.select(layout.headline(F.col("lines"))).collect()] == ["Red-Themed The Mentalist Episodes List", "", ""]
    rows = [("b", 0.105, 0.12, 0.5), ("a", 0.1, 0.12, 0.1), ("c", 0.109, 0.12, 0.9), ("d", 0.112, 0.13, 0.0), ("a", 0.11, 0.12, 0.1)]
    df = spark.createDataFrame([(rows, True), ([], True)], LINES)
    assert [r[0] for r in df.select(layout.reading_order(F.col("lines"))).collect()] == ["a\nb\nc\nd", ""]
    cuts = spark.range(1).select(layout.slices(F.lit(100), F.lit(250)), layout.slices(F.lit(100), F.lit(500))).first()
    assert [[tuple(x) for x in c] for c in cuts] == [[(0, 250)], [(0, 200), (190, 390), (380, 500)]]


def test_reading_order_of_long_and_null_texts(spark, tmp_path):
    texts = ["a\nb\na", "\n".join(f"line {k}" for k in range(406)), "\n".join(f"same {k % 7}" for k in range(30_000)), None, " \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = {r["id"]: r["text_md5"] for r in own.QUERIES["reading_order"](spark, str(tmp_path)).collect()}
    want = {}
    for i, text in enumerate(texts[:1] + texts[4:]):
        want[i * 4] = brute_order(
            [(x, np.float32(k / n), np.float32(0)) for n in [text.count("\n") + 1] for k, x in enumerate(text.split("\n")) if x.strip()]
        )
    for i in (1, 2):
        ls = texts[i].split("\n")
        want[i] = brute_order([(x, np.float32(k / len(ls)), np.float32(0)) for k, x in enumerate(ls)])
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in want.items()} | {3: None}


def brute_order(lines):
    """As the reference reads: each line against all kept lines."""
    kept = []
    for x, top, left in sorted(lines, key=lambda p: (p[1], p[2], p[0])):
        if all(y != x or abs(t - top) >= np.float32(0.02) for y, t, _ in kept):
            kept.append((x, top, left))
    rows = []
    for p in kept:
        if not rows or p[1] - rows[-1][0][1] > np.float32(0.01):
            rows.append([])
        rows[-1].append(p)
    return "\n".join(x for row in rows for x, _, _ in sorted(row, key=lambda p: (p[2], p[0])))


def test_reading_order_of_odd_lines(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("x", 0.5, 0.6, 0.2), ("x", 0.515, 0.6, 0.1), ("x", 0.53, 0.6, 0.0), (None, 0.5, 0.6, 0.0), ("n", None, None, None), ("n", None, None, 0.5),
        ("q", nan, nan, 0.1), ("q", nan, nan, 0.2), ("i", inf, inf, 0.0)
    ]
    df = spark.createDataFrame([(rows, True), (None, True)], LINES)
    assert [r[0] for r in df.select(layout.reading_order(F.col("lines"))).collect()] == ["n\nn\nx\nx\ni\nq\nq", None]


def test_captions(spark):
    df = spark.createDataFrame([("cricket ball<loc_12><loc_40>footwear<loc_1><loc_2>",), ("",), (None,)], "o string")
    assert [r[0] for r in df.select(captions.objects(F.col("o"))).collect()] == [["cricket ball", "footwear"], [], []]
    rows = [
        ("a woman", "The image shows a woman. It is big.", "footwear<loc_1>human face<loc_2>person<loc_3>", "25 Save"),
        (
            "a picture of a phone", 'The image shows a phone. The text reads "How to get a VMR card from Netflix" and icons.',
            "mobile phone<loc_1>", "VM-HDFCBK Messages For NETFLIX From HDFC Bank Credit Card"
        ),
        ("a number", 'It reads "RMA Tracker" and a link.', "mobile phone<loc_1>", "Kaizen Whatsapp us: RMA Tracker Enter RMA Number Submit"),
        ("a bunch of things", "The image shows music bands.", "mobile phone<loc_1>", "r/TheMentalist"), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "c string, d string, o string, s string")
    got = [tuple(r[0]) for r in df.select(captions.describe(*(F.col(x) for x in "cdos"))).collect()]
    assert got == [
        ("The image shows a woman. It is big.", ["footwear", "person"]), ("A picture of a phone", []), ('It reads "RMA Tracker" and a link.', []),
        ("A bunch of things", []), ("", [])
    ]


def test_detokenize(spark):
    tokens = ["<s>", "Ġhello", "Ã©", "<loc_1>"]
    df = spark.createDataFrame([([0, 1, 2, 3, 9],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(captions.detokenize(F.col("ids"), tokens, {0})).collect()] == [" helloé<loc_1>", ""]


def test_enrich(spark):
    lines = [("google.com/search", 0.05, 0.08), ("Big Title Here", 0.2, 0.3), ("small text", 0.4, 0.42), ("more text", 0.5, 0.52)]
    df = spark.createDataFrame(
        [(1, "Capture_20240229-103000_Chrome.png", "buy now wishlist 450/-", lines), (2, None, None, None)],
        "id long, name string, ocr_text string, lines array<struct<text:string,top:float,bottom:float>>"
    )
    a, b = enrich(df, TODAY).orderBy("id").collect()
    assert (a["app"], a["page_url"], a["headline"], a["categories"], [e["value"] for e in a["entities"]]) == (
        "Chrome", "https://google.com/search", "Big Title Here", ["shopping"], ["₹450"]
    )
    assert b["app"] is None and b["entities"] == []

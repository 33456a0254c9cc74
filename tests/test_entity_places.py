"""Entities are looked for only where a match can begin: the same as a search over the whole text, in less time."""

import random
import re
import time
from datetime import date
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quillspark.operators import entities as e

PIECES = (
    "a b-c_d . .. - / : :// @ @@ + +91 91 6 98765 43210 9876543210 1800 123 4567 2026 2026-05-17 17/05/2026 1.5.26 17 5 may May. sept september jan "
    "3rd 21st oct 2028 12:30 pm 3 am OTP otp code pin one-time password verification rs Rs. inr ₹ $ € £ 1,234.50 234 /- rupees INR www. www http https "
    "http://x.y example.com shop.in a.co.uk x-y.dev /path? # .com %u +1 (202) 555 0123 é ſ ١ ' \" < ` , ; ) ] 00000000 12345678901"
).split()


def whole(kind, text):
    return [m.span() for m in e._RX[kind].finditer(text)]


def by_place(text):
    runs = [m.span() for m in e._DIGITS.finditer(text)]
    ats = [m.start() for m in re.finditer("@", text)]
    starts = e._days(text, runs) | {"MONTH_DAY": e._months(text, runs), "AMOUNT": e._amounts(text, runs), "PHONE": e._phones(text, runs)}
    out = {k: [m.span() for m in e._tried(k, text, s)] for k, s in starts.items()}
    out |= {k: [m.span() for m in f] for k, f in (("EMAIL", e._emails(text, ats)), ("UPI", e._payment_ids(text, ats)), ("URL", e._links(text)), ("CODE", e._codes(text, runs)))}
    return out


@pytest.mark.parametrize("seed", range(8))
def test_matches_are_those_of_the_whole_text(seed):
    rng = random.Random(seed)
    letters = "aA1 9.-@:/+,_%\n\trsS5w4m"
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) + rng.choice(("", "", " ", " ", "  ", "\n", ".", "-", "@", "/")) for _ in range(rng.randint(1, 14)))
        if rng.random() < 0.3:
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        for kind, spans in by_place(text).items():
            assert spans == whole(kind, text), (kind, text)


def test_spans_at_the_edges_of_what_is_looked_at():
    for n in (1, 2, 62, 63, 64, 65, 200):
        for m in (1, 2, 32, 33, 34, 60):
            for end in ("", " x", "-", "@q"):
                text = f"see {'a' * n}@{'b' * m}{end} {'c-' * n}d@{'e' * m}.com"
                assert {k: whole(k, text) for k in ("EMAIL", "UPI", "URL")} == {k: v for k, v in by_place(text).items() if k in ("EMAIL", "UPI", "URL")}
    for word in ("otp", "one-time password", "Verification code"):
        for n in range(18, 24):
            text = f"1 {word}{'-' * n}1234 {word}{' ' * (n - 1)}12345678"
            assert by_place(text)["CODE"] == whole("CODE", text)


def test_a_text_of_many_kinds_takes_less_time():
    """Several times what the whole search of the patterns alone takes, when all are searched everywhere."""
    text = " and then after quite a number of words ".join(["Mail", "c0@Mail.example.com", "see www.shop0.example.net/o.", "Your OTP is 100000", "2026-01-10", "10 Oct 2028", "Rs. 1,234.50"] * 4)
    least = lambda f: min((f(), time.perf_counter() - t)[1] for _ in range(15) for t in [time.perf_counter()])
    own = least(lambda: e.entities(text, date(2026, 10, 3), ZoneInfo("UTC")))
    assert own < 0.6 * least(lambda: [whole(k, text) for k in e._RX if k != "TIME"])


def test_texts_without_entities_among_others(spark):
    df = spark.createDataFrame([(1, "no entity 1"), (2, None), (3, "a@b.com, pay $5"), (4, "")], "id long, text string")
    got = {r["id"]: r["e"] for r in e.with_entities(df, "text", date(2026, 10, 3)).select("id", F.transform("entities", lambda x: x["value"]).alias("e")).collect()}
    assert got == {1: [], 2: [], 3: ["a@b.com", "$5"], 4: []}

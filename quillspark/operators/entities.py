"""Entities of a text: links, addresses, phones, payment ids, amounts, dates, codes.

Matches claim ranges of characters; a later match that overlaps a claim is dropped, so kinds come in a fixed order. Spark's
regular-expression functions give no offsets and the kinds look around their matches, so this is one Arrow UDF; texts
without a digit, an @ or a dot can hold no entity and never leave the JVM. A pattern is only tried where a match of it can begin, which
the runs of digits, the @ signs and the dots of a text tell; the matches are those of a search over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime, timedelta
from functools import lru_cache
from itertools import accumulate
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import ENTITY_PATTERNS, MONTHS

TYPE = "array<struct<type:string,text:string,value:string,epoch_millis:long,has_time:boolean>>"
_FIELDS = [pa.field(n, t) for n, t in zip(("type", "text", "value", "epoch_millis", "has_time"), (pa.string(),) * 3 + (pa.int64(), pa.bool_()), strict=True)]
_RX = {k: re.compile(p, re.ASCII) for k, p in ENTITY_PATTERNS.items()}
_NUMBER = re.compile(r"[0-9][0-9,]*(?:\.[0-9]{1,2})?")
_DIGITS, _DOT = re.compile(r"[0-9]+"), re.compile(r"\.|://")
_LETTERS, _SPACE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset(" \t\n\r\f\v")
_HOST = _LETTERS | set("0123456789.-")
_HANDLE = _HOST | {"_"}
_LOCAL = _HANDLE | set("%+")
#: The most code points of a code's keyword and the way to its digits; of a payment id's name, and of its bank with what must not follow.
_CODE_REACH, _NAME_REACH, _BANK_REACH = 38, 64, 34
Runs = list[tuple[int, int]]


def _date(y: int, m: int, d: int) -> date | None:
    if not 1990 <= y <= 2100:
        return None
    try:
        return date(y, m, d)
    except ValueError:
        return None


def _year(y: int) -> int:
    return 2000 + y if y < 100 else y


def _next(day: int, month: int, year: str | None, today: date) -> date | None:
    """A date; without a year it is this year's, or next year's if that was over 31 days ago."""
    if year:
        return _date(_year(int(year)), month, day)
    d = _date(today.year, month, day)
    if d and d < today - timedelta(31):
        return d.replace(year=d.year + 1) if (d.month, d.day) != (2, 29) else date(d.year + 1, 2, 28)
    return d


def _clock(m: re.Match) -> tuple[int, int] | None:
    hour, minute, half = (int(m[1]), int(m[2]), m[3]) if m[1] else (int(m[4]), 0, m[5])
    half = (half or "").lower()[:1]
    hour += 12 if half == "p" and hour < 12 else -12 if half == "a" and hour == 12 else 0
    return (hour, minute) if hour < 24 and minute < 60 else None


def _month(name: str) -> int:
    return MONTHS.index(name.lower()[:3]) + 1


def _before(text: str, a: int, of: frozenset[str], low: int) -> int:
    """Where the characters of a set that end at a begin, not before low."""
    while a > low and text[a - 1] in of:
        a -= 1
    return a


def _tried(kind: str, text: str, starts: Iterable[int]) -> Iterator[re.Match]:
    """The matches of a kind, which begin at some of the rising places only."""
    rx, end = _RX[kind], 0
    for s in starts:
        if s >= end and (m := rx.match(text, s)):
            end = m.end()
            yield m


def _emails(text: str, ats: list[int]) -> Iterator[re.Match]:
    end = 0
    for a in ats:
        s = _before(text, a, _LOCAL, end)
        if s < a and (m := _RX["EMAIL"].match(text, s)):
            end = m.end()
            yield m


def _payment_ids(text: str, ats: list[int]) -> Iterator[re.Match]:
    end = 0
    for a in ats:
        s = _before(text, a, _HANDLE, max(end, a - _NAME_REACH))
        if s < a and (m := _RX["UPI"].search(text, s, a + _BANK_REACH)) and m.start() < a:
            end = m.end()
            yield m


def _links(text: str) -> Iterator[re.Match]:
    """A link begins where a run of a host's characters does, or within one after a dot or hyphen; it has a dot, or :// after the run."""
    end = done = 0
    for anchor in _DOT.finditer(text):
        i = anchor.start()
        if i < done:
            continue
        done, a = i, _before(text, i, _HOST, end)
        while done < len(text) and text[done] in _HOST:
            done += 1
        for s in range(a, done):
            if s >= end and (s == a or text[s - 1] in ".-") and (m := _RX["URL"].match(text, s)):
                end = m.end()
                yield m
        done = max(done, end, i + 1)


def _codes(text: str, runs: Runs) -> Iterator[re.Match]:
    last = 0
    for a, z in runs:
        if 4 <= z - a <= 8 and (m := _RX["CODE"].search(text, max(last, a - _CODE_REACH), z + 1)):
            yield m
        last = z


def _days(text: str, runs: Runs) -> dict[str, list[int]]:
    """Where the forms of a date begin that begin with a number, by its digits and the character after it."""
    short = [(a, text[z : z + 1]) for a, z in runs if z - a <= 2]
    return {
        "ISO_DATE": [a for a, z in runs if z - a == 4 and text[z : z + 1] == "-"], "NUMERIC_DATE": [a for a, c in short if c and c in "/.-"],
        "DAY_MONTH": [a for a, c in short if c and c in "-sSnNrRtT \t\n\r\f\v"]
    }


def _months(text: str, runs: Runs) -> Iterator[int]:
    """Where the words before short numbers begin."""
    for a, z in runs:
        if z - a <= 2 and a and text[a - 1] in _SPACE:
            b = _before(text, a, _SPACE, 0)
            b -= b > 0 and text[b - 1] == "."
            s = _before(text, b, _LETTERS, max(0, b - 10))
            if s < b:
                yield s


def _amounts(text: str, runs: Runs) -> list[int]:
    """Where numbers begin, or the signs and names of currencies before them."""
    back = {".": 3, "s": 2, "S": 2, "r": 3, "R": 3, "₹": 1, "$": 1, "€": 1, "£": 1}
    found = {a for a, _ in runs}
    for a, _ in runs:
        for b in (a, a - 1) if a and text[a - 1] in _SPACE else (a,):
            if b and (n := back.get(text[b - 1])) and n <= b:
                found.add(b - n)
    return sorted(found)


def _phones(text: str, runs: Runs) -> Iterator[int]:
    for a, z in runs:
        if a and text[a - 1] == "+":
            yield a - 1
        elif z - a >= 4 or z - a == 2:
            yield a


@lru_cache(1 << 16)
def _millis(d: date, clock: tuple[int, int] | None, zone: ZoneInfo) -> int:
    return int(datetime(d.year, d.month, d.day, *(clock or (9, 0)), tzinfo=zone).timestamp() * 1000)


#: How each form of a date reads: its pattern and what makes a date of a match.
_DATES: tuple[tuple[str, Callable[[re.Match, date], date | None]], ...] = (
    ("ISO_DATE", lambda m, t: _date(int(m[1]), int(m[2]), int(m[3]))),
    ("NUMERIC_DATE", lambda m, t: _date(_year(int(m[3])), int(m[2]), int(m[1]))),
    ("DAY_MONTH", lambda m, t: _next(int(m[1]), _month(m[2]), m[3], t)),
    ("MONTH_DAY", lambda m, t: _next(int(m[2]), _month(m[1]), m[3], t)),
)


def _dates(text: str, runs: Runs, today: date, zone: ZoneInfo) -> Iterator[tuple[int, int, tuple]]:
    starts = _days(text, runs) | {"MONTH_DAY": _months(text, runs)}
    for kind, read in _DATES:
        for m in _tried(kind, text, starts[kind]):
            if (d := read(m, today)) is None:
                continue
            a, z = m.span()
            after = text[z : z + 29]
            near = _RX["TIME"].search(after) if _DIGITS.search(after) else None
            clock = _clock(near) if near else None
            z += near.end() if near else 0
            yield a, z, ("DATE", text[a:z], f"{d}T{clock[0]:02}:{clock[1]:02}" if clock else str(d), _millis(d, clock, zone), clock is not None)


def _found(text: str, today: date, zone: ZoneInfo) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, entity) of all matches, in the order in which they may claim their range."""
    plain = lambda kind, t, value: (kind, t, value, None, False)
    runs = [m.span() for m in _DIGITS.finditer(text)]
    ats = [m.start() for m in re.finditer("@", text)] if "@" in text else []
    for m in _emails(text, ats):
        yield *m.span(), plain("EMAIL", m[0], m[0].lower())
    for m in _payment_ids(text, ats):
        yield *m.span(), plain("UPI", m[0], m[0])
    for m in _links(text):
        raw = m[0].rstrip(".,;:!?)]")
        if len(raw) > 4:
            yield m.start(), m.start() + len(raw), plain("URL", raw, raw if raw[:4].lower() == "http" else "https://" + raw)
    for m in _codes(text, runs):
        yield *m.span(2), plain("CODE", m[2], m[2])
    yield from _dates(text, runs, today, zone)
    for m in _tried("AMOUNT", text, _amounts(text, runs)):
        sign = next((s for s in "$€£" if s in m[0]), "₹")
        yield *m.span(), plain("AMOUNT", m[0].strip(), sign + _NUMBER.search(m[0])[0].replace(",", ""))
    for m in _tried("PHONE", text, _phones(text, runs)):
        digits = re.sub(r"[^0-9+]", "", m[0])
        if 10 <= len(digits.removeprefix("+")) <= 13:
            yield *m.span(), plain("PHONE", m[0].strip(), digits)


def entities(text: str, today: date, zone: ZoneInfo) -> list[tuple]:
    """The entities of a text: all matches in the order of their priority, each dropped if it overlaps an earlier one that stayed."""
    found = list(_found(text, today, zone))
    out: dict[tuple[str, str], tuple] = {}
    for k in settled([(a, z) for a, z, _ in found]):
        e = found[k][2]
        out.setdefault(e[0:3:2], e)
    return list(out.values())


def settled(spans: list[tuple[int, int]]) -> list[int]:
    """Which spans keep their range, when each claims it unless an earlier one has part of it. What is claimed is a row of marks between
    the spans' ends in order, so the work is that of sorting the ends and of the marks that claims cover; claims are disjoint."""
    ends = sorted({x for s in spans for x in s})
    place = {x: k for k, x in enumerate(ends)}
    taken, stay = bytearray(len(ends)), []
    for k, (a, z) in enumerate(spans):
        i, j = place[a], place[z]
        if taken.find(1, i, j) < 0:
            taken[i:j] = b"\1" * (j - i)
            stay.append(k)
    return stay


def extract(text: Column, today: date, zone: str = "UTC") -> Column:
    """The entities of a text in the order of their claims, each (type, value) once."""
    tz = ZoneInfo(zone)

    @F.arrow_udf(TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found = [entities(t or "", today, tz) for t in b.to_pylist()]
            columns = zip(_FIELDS, zip(*(e for es in found for e in es), strict=True) if any(found) else ((),) * len(_FIELDS), strict=True)
            rows = pa.StructArray.from_arrays([pa.array(c, f.type) for f, c in columns], fields=_FIELDS)
            yield pa.ListArray.from_arrays(pa.array(accumulate(map(len, found), initial=0), pa.int32()), rows)

    return run(text)


def with_entities(df: DataFrame, text_col: str, today: date, zone: str = "UTC") -> DataFrame:
    """df with the column `entities`."""
    may = F.coalesce(F.col(text_col).rlike(r"[0-9@]|\.[A-Za-z]|(?i:www|http)"), F.lit(False))
    return df.withColumn("entities", F.when(may, extract(F.when(may, F.col(text_col)), today, zone)).otherwise(F.array().cast(TYPE)))


def emails(text: Column) -> Column:
    """The distinct e-mail values of a text, sorted; JVM only."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS["EMAIL"]), F.lit(0)), F.lower)))


def phones(text: Column) -> Column:
    """The distinct phone values of a text, sorted, whatever else claims their place; JVM only."""
    raw = F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS["PHONE"]), F.lit(0))
    digits = F.transform(raw, lambda p: F.regexp_replace(p, "[^0-9+]", ""))
    return F.array_sort(F.array_distinct(F.filter(digits, lambda d: F.length(F.ltrim(d, F.lit("+"))).between(10, 13))))

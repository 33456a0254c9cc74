"""Lines of a screen: reading order, slices, the page's link, the headline. Arrays and higher-order functions, no shuffle; the rows
of the reading order need Python.

Lines are array<struct<text, top, bottom>> (reading order also needs `left`), places as fractions of the height.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.dictionaries import PAGE_ENDINGS, PAGE_TOKEN


def single(x: float) -> Column:
    return F.lit(x).cast("float")


@F.arrow_udf(ArrayType(IntegerType()))
def screen_rows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The row of each line, null for a line read twice; tops and texts in order of place. Of the kept lines of one text the last
    is the nearest, so that one look-up a line tells, however many lines there are."""
    near, below = np.float32(0.02), np.float32(0.01)
    for tops, texts in batches:
        out = []
        for ts, xs in zip(tops, texts, strict=True):
            if not ts.is_valid:
                out.append(None)
                continue
            last: dict[str, np.float32] = {}
            row, first, rows = 0, None, []
            for t, x in zip(ts.values.to_pylist(), xs.values.to_pylist(), strict=True):
                if t is not None:
                    t = np.float32(t)
                    if x is not None:
                        if x in last and t - last[x] < near:
                            rows.append(None)
                            continue
                        last[x] = t
                if first is None or t is not None and not t - first <= below:
                    row, first = row + 1, t
                rows.append(row)
            out.append(rows)
        yield pa.array(out, pa.list_(pa.int32()))


def reading_order(lines: Column) -> Column:
    """The text of a screen: lines read twice (the same text within 0.02) once; a row holds lines up to 0.01 below its first line,
    from left to right; rows joined by line ends. Null lines give null, no lines an empty text."""
    by_place = F.array_sort(F.transform(lines, lambda x: F.struct(x["top"].alias("top"), x["left"].alias("left"), x["text"].alias("text"))))
    rows = screen_rows(F.transform(by_place, lambda x: x["top"]), F.transform(by_place, lambda x: x["text"]))
    numbered = F.filter(
        F.zip_with(by_place, rows, lambda x, r: F.struct(r.alias("row"), x["left"].alias("left"), x["text"].alias("text"))),
        lambda x: x["row"].isNotNull()
    )
    return F.array_join(F.transform(F.array_sort(numbered), lambda x: x["text"]), "\n")


def slices(width: Column, height: Column) -> Column:
    """array<struct<top, bottom>> in pixels: a screen over 2.5 times as high as wide is read in slices twice as high as wide that
    overlap by a tenth of the width."""
    size, step = width * 2, width * 2 - F.floor(width / 10)
    tops = F.sequence(F.lit(0).cast("long"), F.greatest(height - 1, F.lit(0)).cast("long"), F.greatest(step, F.lit(1)).cast("long"))
    cut = F.transform(tops, lambda t: F.struct(t.alias("top"), F.least(t + size, height).cast("long").alias("bottom")))
    # The slice that reaches the bottom is the last one.
    last = F.filter(cut, lambda x: (x["top"] == 0) | (x["top"] + (size - step) < height))
    return F.when(height > width * 2 + F.floor(width / 2), last).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("top"), height.cast("long").alias("bottom")))
    )


def page_link(lines: Column, browser: Column) -> Column:
    """The first link-like word near the top: the address bar of a browser, elsewhere only an explicit link."""
    region = F.when(browser, single(0.22)).otherwise(single(0.12))
    top = F.filter(
        F.array_sort(F.transform(lines, lambda x, k: F.struct(x["top"].alias("top"), k.alias("k"), x["text"].alias("text")))),
        lambda x: x["top"] <= region
    )
    words = F.flatten(F.transform(top, lambda x: F.split(x["text"], "[ \t]")))
    bare = F.transform(words, lambda w: F.btrim(F.btrim(F.replace(w, F.lit("🔒"), F.lit(""))), F.lit("|•·\"'()[]<>,")))
    http = lambda t: F.lower(F.substring(t, 1, 4)) == "http"
    explicit = lambda t: http(t) | (F.lower(F.substring(t, 1, 4)) == "www.")
    good = F.filter(
        bare,
        lambda t: (F.length(t) >= 4) & ~F.contains(t, F.lit("@")) & t.rlike(PAGE_TOKEN) & (browser | explicit(t)) & (
            explicit(t) | F.lower(F.regexp_extract(t, PAGE_TOKEN, 1)).isin(*PAGE_ENDINGS)
        )
    )
    first = F.get(good, F.lit(0))
    return F.when(http(first), first).otherwise(F.concat(F.lit("https://"), first))


def page_link_of_text(text: Column) -> Column:
    """The link in the first four lines of a stored text, read as an address bar."""
    lines = F.slice(F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), 1, 4)
    return page_link(F.transform(lines, lambda x: F.struct(x.alias("text"), single(0.05).alias("top"), single(0.08).alias("bottom"))), F.lit(True))


def headline(lines: Column, most: int = 6) -> Column:
    """The tallest lines, at least 1.4 times the (upper) median height, in reading order; empty if fewer than three lines can be used."""
    clock = r"(?i)^\d{1,2}[.:]\d{2}(\s?[ap]\.?m\.?)?$"
    usable = F.filter(
        lines, lambda x: (x["bottom"] > x["top"]) & (F.length(F.regexp_replace(x["text"], r"[^\p{L}]", "")) >= 3) & ~F.trim(x["text"]).rlike(clock)
    )
    # Worked out once each: an expression within a lambda would be worked out again for every line.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return once(usable, lambda u: once(upper_median(u), lambda m: joined(u, m, most)))


def upper_median(usable: Column) -> Column:
    heights = F.array_sort(F.transform(usable, lambda x: x["bottom"] - x["top"]))
    return F.get(heights, (F.size(heights) / 2).cast("int"))


def joined(usable: Column, median: Column, most: int) -> Column:
    tall = F.transform(
        usable, lambda x, k: F.struct((x["top"] - x["bottom"]).alias("down"), k.alias("k"), x["top"].alias("top"), x["text"].alias("text"))
    )
    tall = F.slice(F.array_sort(F.filter(tall, lambda x: -x["down"] >= median * single(1.4))), 1, most)
    # Lines at one height come as they were taken: by size, then as they stood.
    order = F.array_sort(F.transform(tall, lambda x, k: F.struct(x["top"].alias("top"), k.alias("k"), x["text"].alias("text"))))
    return F.when(F.size(usable) < 3, "").otherwise(F.array_join(F.transform(order, lambda x: x["text"]), "\n"))

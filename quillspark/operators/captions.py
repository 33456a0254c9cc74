"""What a picture's captions say, checked against the words on its screen; byte-level detokenising."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dictionaries import GENERIC_OBJECTS

QUOTED = '["“”]([^"“”]{2,})["“”]'


def objects(raw: Column) -> Column:
    """Object labels of an answer in which places stand between them; each once, first seen first."""
    names = F.transform(F.split(F.coalesce(raw, F.lit("")), r"(?:<loc_\d+>)+"), lambda x: F.lower(F.btrim(x, F.lit(" .,"))))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def on_screen(quote: Column, screen_words: Column) -> Column:
    """Whether most words of a quote (seven tenths, one at least) are among the screen's."""
    ws = words(quote)
    need = F.greatest(F.lit(1), F.floor(F.size(ws) * F.lit(0.7)))
    return (F.size(ws) > 0) & (F.size(F.filter(ws, lambda w: F.array_contains(screen_words, w))) >= need)


def describe(caption: Column, detailed: Column, objects_raw: Column, screen_text: Column) -> Column:
    """struct<text, objects>: of pictures (with objects that say something) the detailed sentences without an untrue quote; of other screens
    those with quotes, all true; else the short caption."""
    kept = F.filter(objects(objects_raw), lambda o: ~o.isin(*GENERIC_OBJECTS))
    screen = F.array_distinct(words(F.coalesce(screen_text, F.lit(""))))
    sentences = F.filter(F.split(F.trim(F.coalesce(detailed, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    quotes = lambda s: F.regexp_extract_all(s, F.lit(QUOTED), F.lit(1))
    true = lambda s: F.forall(quotes(s), lambda q: on_screen(q, screen))
    text = F.when(F.size(kept) > 0, F.array_join(F.filter(sentences, true), " ")).otherwise(
        F.array_join(F.filter(sentences, lambda s: (F.size(quotes(s)) > 0) & true(s)), " ")
    )
    text = F.trim(F.when(F.trim(text) == "", F.trim(F.coalesce(caption, F.lit("")))).otherwise(text))
    return F.struct(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)).alias("text"), kept.alias("objects"))


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def detokenize(ids: Column, tokens: list[str], special: set[int]) -> Column:
    """Text of token ids; special ones are dropped, symbols that stand for no byte are kept as they are."""
    table = byte_symbols()
    raw = [b"" if i in special else b"".join(bytes([table[c]]) if c in table else c.encode() for c in t) for i, t in enumerate(tokens)]

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: b"".join(raw[i] for i in x if 0 <= i < len(raw)).decode("utf-8", "replace"), na_action="ignore")

    return run(ids)

"""Text normalisation, word splitting, word forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .dictionaries import FILLER, HTML_NAMES, LIGATURES

WORD = r"[\p{L}\p{M}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"

#: One pass for all single-character replacements: typographic quotes, full-width forms, line separators, ligatures, and control
#: characters (dropped).
_TABLE = (
    {c: "\n" for c in (" ", " ", "\u0085")}
    | {"ʼ": "'"} | {chr(c): "'" for c in range(0x2018, 0x201C)} | {chr(c): '"' for c in range(0x201C, 0x2020)}
    | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"　": " "}
    | {chr(c): "" for r in (range(0, 9), (0x0B,), range(0x0E, 0x20), (0x7F, 0xFEFF), range(0xFFF9, 0xFFFD)) for c in r}
    | LIGATURES
)
_TRANSLATE = str.maketrans(_TABLE)
_ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([a-zA-Z][a-zA-Z0-9]{1,31}));")


def fix_text(s: str) -> str:
    """Line ends, quotes, full-width forms, ligatures and control characters made plain; NFC."""
    return unicodedata.normalize("NFC", s.replace("\r\n", "\n").replace("\r", "\n").translate(_TRANSLATE))


def _reference(m: re.Match) -> str:
    if m[3]:
        return HTML_NAMES.get(m[3], m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return "�" if code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF else chr(code)


def unescape(s: str) -> str:
    """Numeric references and the named ones in HTML_NAMES; others stay."""
    return _ENTITY.sub(_reference, s) if "&" in s else s


def basic_clean(s: str) -> str:
    return unescape(unescape(fix_text(s))).strip()


@F.pandas_udf(StringType())
def fix_text_col(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(fix_text, na_action="ignore")


@F.pandas_udf(StringType())
def unescape_col(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(unescape, na_action="ignore")


@F.pandas_udf(StringType())
def basic_clean_col(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(basic_clean, na_action="ignore")


def unescape_named(c: Column) -> Column:
    """The named references only, without leaving the JVM; `&amp;` last, so that nothing is unescaped twice."""
    for name, text in sorted(HTML_NAMES.items(), key=lambda x: x[0] == "amp"):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(text))
    return c


def _folding() -> tuple[str, str]:
    """Letters with marks that have a plain one, by their canonical decomposition, and the plain ones; then the marks, which go."""
    first = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1}
    return "".join(first) + "".join(map(chr, range(0x300, 0x370))), "".join(first.values())


_MARKED, _PLAIN = _folding()


def folded(c: Column) -> Column:
    """Latin letters without their diacritics."""
    return F.translate(c, _MARKED, _PLAIN)


def folded_text(s: str) -> str:
    return s.translate(str.maketrans(_MARKED[: len(_PLAIN)], _PLAIN, _MARKED[len(_PLAIN) :]))


def padded(c: Column) -> Column:
    """Words in small letters, one space before, between and after them: a word or phrase is found by contains()."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), NOT_WORD, " ")), F.lit(" "))


def padded_text(s: str) -> str:
    return f" {regex.sub(NOT_WORD, ' ', s.lower()).strip()} "


def has(text: Column, phrase: str) -> Column:
    """Whether a padded text has a phrase."""
    return F.contains(text, F.lit(padded_text(phrase)))


def wide_occurrences(wide: Column, phrase: str) -> Column:
    """How often a padded text with its spaces doubled has a phrase; doubled, as neighbours may share a space."""
    needle = padded_text(phrase).replace(" ", "  ")[1:-1]
    return ((F.length(wide) - F.length(F.replace(wide, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def occurrences(text: Column, phrase: str) -> Column:
    """How often a padded text has a phrase."""
    return wide_occurrences(F.replace(text, F.lit(" "), F.lit("  ")), phrase)


def words_of(c: Column) -> Column:
    """Words in small letters, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def query_words(query: str) -> list[str]:
    return regex.findall(WORD, basic_clean(query).lower())


def forms(term: str) -> list[str]:
    """A word and its singular or plural."""
    if len(term) < 3 or any(c.isdigit() for c in term):
        return [term]
    # The first rule whose ending fits: (endings, condition, letters dropped, letters added).
    rules = (
        (("ies",), len(term) > 4, 3, "y"), (("ches", "shes", "xes", "sses"), True, 2, ""), (("ss",), True, 0, "es"), (("s",), True, 1, ""),
        (("y",), len(term) > 3 and term[-2] not in "aeiou", 1, "ies"), (("ch", "sh", "x"), True, 0, "es"), (("",), True, 0, "s"),
    )
    drop, add = next((d, a) for ends, ok, d, a in rules if ok and term.endswith(ends))
    return list(dict.fromkeys([term, term[: len(term) - drop] + add]))


def query_terms(query: str, meanings: dict[str, list[str]] | None = None) -> list[tuple[str, list[str]]]:
    """The words that matter with all that each may match: its forms, and keywords that it stands for."""
    every = query_words(query)
    kept = [w for w in every if w not in FILLER] or every
    return [(w, list(dict.fromkeys(forms(w) + (meanings or {}).get(w, [])))) for w in dict.fromkeys(kept)]


def match_expression(terms: list[tuple[str, list[str]]]) -> str | None:
    """All terms, any alternative of each; phrases in quotes."""
    quoted = lambda a: f'"{a}"' if " " in a else a
    return " ".join(" OR ".join(quoted(a.replace('"', "")) for a in alts) for _, alts in terms) or None


def word_expression(query: str) -> str | None:
    return " ".join(" OR ".join(forms(w)) for w in query_words(query)) or None


def prefix_expression(query: str, every: bool = False) -> str | None:
    ws = query_words(query)
    return " ".join(w + "*" if every or k == len(ws) - 1 else w for k, w in enumerate(ws)) or None


def word_hits(text: Column, terms: list[str]) -> Column:
    """Pairs of a word of the text and a term of which it is a form."""
    ws = words_of(text)
    count = lambda wanted: F.size(F.filter(ws, lambda w: w.isin(wanted)))
    return sum((count(forms(t)) for t in terms), F.lit(0))


def name_key(c: Column) -> Column:
    """Letters and digits in small letters, the rest as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def flat(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\n\s*", " ")

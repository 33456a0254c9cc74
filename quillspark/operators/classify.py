"""Categories of texts, and the app that a record comes from. One automaton finds all keywords of a text in one pass (Arrow batches);
the rest is declared, with the dictionaries as literals in the plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.dictionaries import APP_ALIASES, APP_PHRASES, BROWSER_LABELS, BROWSER_PACKAGES, CAPTURE_FILES, CATEGORY_APPS, CATEGORY_KEYWORDS, HOME_SCREEN, LOCK_CLOCK, LOCK_DATE, LOCK_SCREEN, PACKAGE_GENERIC, PACKAGE_NAMES
from ..functions.text import name_key


def contains_keyword(lower: Column, keyword: str) -> Column:
    """Whether a text in small letters has a keyword: short plain ones as whole words, others anywhere."""
    if len(keyword) <= 4 and keyword.isalnum():
        # The cheap test first; the look-around runs on few texts.
        return F.contains(lower, F.lit(keyword)) & lower.rlike(rf"(?<![\p{{L}}\p{{Nd}}]){re.escape(keyword)}(?![\p{{L}}\p{{Nd}}])")
    return F.contains(lower, F.lit(keyword))


def app_matches(app: Column, name: str) -> Column:
    """Whether an app's name in small letters is meant: short names must be one of its parts."""
    return F.contains(app, F.lit(name)) if len(name) >= 5 else F.array_contains(F.split(app, r"[ ._-]"), name)


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def hits(tests: list[Column]) -> Column:
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: a lambda's variable isn't replaced by its expression."""
    return F.transform(F.array(value), use)[0]


class Keywords:
    """All keywords of several groups in one automaton, which goes over a text once. groups: phrases, each with its parts, all of which
    a text must have."""

    def __init__(self, groups: list[list[tuple[str, ...]]]):
        self.groups = groups
        self.automaton = ahocorasick.Automaton()
        for part in {p for phrases in groups for parts in phrases for p in parts}:
            self.automaton.add_word(part, (part, len(part) <= 4 and part.isalnum()))
        self.automaton.make_automaton()

    def found(self, lower: str) -> set[str]:
        """The keywords that a text in small letters has: short plain ones as whole words, others anywhere."""
        out: set[str] = set()
        inside = lambda k: 0 <= k < len(lower) and (lower[k].isalpha() or lower[k].isdecimal())
        for end, (part, whole) in self.automaton.iter(lower):
            if part not in out and not (whole and (inside(end + 1) or inside(end - len(part)))):
                out.add(part)
        return out

    def held(self, lower: str) -> list[list[bool]]:
        """Of each group which phrases a text has."""
        own = self.found(lower)
        return [[bool(own) and all(p in own for p in parts) for parts in phrases] for phrases in self.groups]


@cache
def _category_words() -> Keywords:
    return Keywords([[(w,) for w in ws] for ws in CATEGORY_KEYWORDS.values()])


@cache
def _app_words() -> Keywords:
    return Keywords([[tuple(p if p.startswith(" ") else p.strip() for p in phrase.split("+")) for phrase in phrases] for phrases in APP_PHRASES.values()])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def keyword_counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """How many keywords of each category a text in small letters has."""
    for column in texts:
        yield pa.array([[sum(g) for g in _category_words().held(t or "")] for t in column.to_pylist()], pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def phrase_weights(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The weights of each app's phrases that a text in small letters has, added up."""
    weights = [list(phrases.values()) for phrases in APP_PHRASES.values()]
    for column in texts:
        rows = ([sum(w for w, ok in zip(ws, g, strict=True) if ok) for ws, g in zip(weights, _app_words().held(t or ""), strict=True)] for t in column.to_pylist())
        yield pa.array(list(rows), pa.list_(pa.int32()))


def classify(text: Column, app: Column) -> Column:
    """Up to three categories, best first, ties in their declared order. Tenths make the scores whole: 6 a keyword (four at most),
    20 for the app."""
    names = F.array(*(F.lit(c) for c in CATEGORY_KEYWORDS))
    counts = keyword_counts(F.lower(text))
    own = once(F.lower(app), lambda a: F.array(*(any_of([app_matches(a, x) for x in CATEGORY_APPS[c]]) for c in CATEGORY_KEYWORDS)))
    score = lambda n, o: F.when(o | (n >= 2), -6 * F.least(n, F.lit(4)) - F.when(o, 20).otherwise(0))
    ranked = F.filter(
        F.transform(F.zip_with(counts, own, score), lambda down, k: F.struct(down.alias("down"), k.alias("k"))), lambda x: x["down"].isNotNull()
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, 3), lambda x: F.get(names, x["k"]))


def categories_of_app(app: Column) -> Column:
    name = F.lower(app)
    return F.array_compact(F.array(*(F.when(any_of([app_matches(name, a) for a in names]), c) for c, names in CATEGORY_APPS.items())))


def is_lock_screen(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(F.lower(text), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(lines) <= 14) & F.exists(lines, lambda x: x.rlike(LOCK_DATE)) & F.exists(lines, lambda x: x.rlike(LOCK_CLOCK))


def app_scores(text: Column) -> Column:
    """array<struct<app, score>> of the apps whose interface words a text has, best first, ties in their declared order."""
    names = F.array(*(F.lit(app) for app in APP_PHRASES))
    scores = phrase_weights(F.concat(F.lit(" "), F.replace(F.lower(text), F.lit("\n"), F.lit(" "))))
    ranked = F.array_sort(F.filter(F.transform(scores, lambda s, k: F.struct((-s).alias("down"), k.alias("k"))), lambda x: x["down"] < 0))
    return F.transform(ranked, lambda x: F.struct(F.get(names, x["k"]).alias("app"), (-x["down"]).alias("score")))


def app_candidates(text: Column) -> Column:
    """Up to two apps with two points or more, best first."""
    clear = F.transform(F.slice(F.filter(app_scores(text), lambda x: x["score"] >= 2), 1, 2), lambda x: x["app"])
    return F.when(is_lock_screen(text), F.array(F.lit(LOCK_SCREEN))).otherwise(clear)


def app_of_text(text: Column) -> Column:
    """The app whose interface words clearly win, else null."""
    s = app_scores(text)
    top, second = F.get(s, F.lit(0)), F.coalesce(F.get(s, F.lit(1))["score"], F.lit(0))
    clear = (top["score"] >= 2) & ((top["score"] - second >= 2) | ((second < 2) & (top["score"] > second)))
    return F.when(is_lock_screen(text), LOCK_SCREEN).when(clear, top["app"])


def app_of_file_name(name: Column) -> Column:
    """struct<label, package> that the file name of a screen's picture tells, null if it tells none."""
    base = F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"^(.*)\.", 1)).otherwise(name)
    prefix = rf"^(?i)({'|'.join(CAPTURE_FILES)})[_-]?"
    rest = F.regexp_replace(base, prefix, "")
    chunk = r"^[0-9][0-9_.\-]{5,}[0-9](?:[_\-]|$)"
    tail = F.btrim(F.regexp_replace(rest, chunk, ""), F.lit("_- "))
    told = base.rlike(prefix) & rest.rlike(chunk) & ~tail.rlike(r"^[0-9_-]*$")
    tail = F.regexp_replace(tail, r"[_-][0-9a-f]{6,}$", "")
    package = tail.rlike(r"^[a-zA-Z][a-zA-Z0-9_]*(\.[a-zA-Z0-9_]+)+$")
    return F.when(told, F.struct(F.when(~package, F.replace(tail, F.lit("_"), F.lit(" "))).alias("label"), F.when(package, tail).alias("package")))


def label_of_package(package: Column) -> Column:
    """A known package's name, else its last part that names something, capitalised."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in PACKAGE_NAMES.items() for x in kv)), package)
    parts = F.filter(F.split(package, r"\."), lambda p: ~p.isin(*PACKAGE_GENERIC))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), package)
    return F.coalesce(known, F.concat(F.upper(F.substring(last, 1, 1)), F.substring(last, 2, 1 << 20)))


def is_browser(label: Column, package: Column) -> Column:
    return F.coalesce(package.isin(*BROWSER_PACKAGES), F.lit(False)) | F.coalesce(F.lower(label).isin(*BROWSER_LABELS), F.lit(False))


def app_aliases(answer: Column) -> Column:
    """An answer as a key, other names of an app replaced by the usual one."""
    key = name_key(answer)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in APP_ALIASES.items() for x in kv)), key), key)


def match_apps(answers: DataFrame, installed: DataFrame) -> DataFrame:
    """answers (id, answer) with the label and package of the installed app (label, package, position) that is meant, null if none is.
    Tiers: the same name; the same without a leading `google `; one name a word longer than the other. The first two are equi-joins,
    the last joins on the first word, which two such names share, so no tier compares every answer with every app."""
    a = answers.select("id", app_aliases(F.col("answer")).alias("n")).filter("n <> ''")
    lock = F.contains(F.col("n"), F.lit("lock screen")) | F.col("n").isin("lockscreen", "lock")
    home = F.contains(F.col("n"), F.lit("home screen")) | F.col("n").isin("homescreen", "launcher")
    screens = a.withColumn("label", F.when(lock, LOCK_SCREEN).when(home, HOME_SCREEN))
    rest = screens.filter("label is null").drop("label")
    apps = installed.select("label", "package", "position", name_key(F.col("label")).alias("l"))
    bare = lambda c: F.regexp_replace(c, "^google ", "")
    tiers = [
        rest.join(apps, F.col("n") == F.col("l")).withColumn("tier", F.struct(F.lit(1).alias("t"), F.lit(0).alias("size"), "position")),
        rest.join(apps, bare(F.col("n")) == bare(F.col("l"))).withColumn("tier", F.struct(F.lit(2).alias("t"), F.lit(0).alias("size"), "position")),
        rest.join(
            apps,
            (F.split("n", " ")[0] == F.split("l", " ")[0]) & (F.length("n") >= 4) & (F.length("l") >= 4) & (
                F.startswith("l", F.concat("n", F.lit(" "))) | F.startswith("n", F.concat("l", F.lit(" ")))
            )
        )
        .withColumn("tier", F.struct(F.lit(3).alias("t"), F.length("l").alias("size"), "position")),
    ]
    best = tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).groupBy("id").agg(F.min_by(F.struct("label", "package"), "tier").alias("m")).select(
        "id", "m.label", "m.package"
    )
    named = screens.filter("label is not null").select("id", "label", F.lit(None).cast("string").alias("package"))
    return answers.join(best.unionByName(named), "id", "left")


def first_by_label(parts: list[DataFrame]) -> DataFrame:
    """(label, package): lists of choices one after another, each label (without regard to case) once, the first one stays."""
    whole = None
    for k, p in enumerate(parts):
        p = p.select("label", "package", F.lit(k).alias("part"), "position")
        whole = p if whole is None else whole.unionByName(p)
    w = Window.partitionBy(F.lower("label")).orderBy("part", "position", "label")
    return whole.withColumn("r", F.row_number().over(w)).filter("r = 1").select("label", "package", "part", "position")

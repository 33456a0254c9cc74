"""Precise search: every word of a query must match, ranked by where it matches.

Records need the columns id, strong, described, body and taken_at. Queries are parsed on the driver; everything else is
declared. A cheap contains() on the small-letter text runs before the padded forms are made; ranking reads the texts once and writes what it
found, without them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_query
from ..functions.dictionaries import CATEGORY_FILLER, CATEGORY_LABELS, CATEGORY_SYNONYMS
from ..functions.text import NOT_WORD, basic_clean, flat, folded, folded_text, has, padded, query_terms, query_words, wide_occurrences
from .ranking import bind, done_with, numbered, written

Terms = list[tuple[str, list[str]]]
#: What a match counts in each place, what a repetition and the phrase add, and the share of the top score that makes `best`.
STRONG, DESCRIBED, BODY, REPEAT, PHRASE, KEEP = 3.0, 2.0, 1.0, 0.2, 1.5, 0.6


def single(x: float | Column) -> Column:
    """32-bit arithmetic: ties and the bar for `best` depend on it."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def texts(records: DataFrame, fold: bool = False) -> DataFrame:
    """records with `_low`: all their text in small letters, with `fold` without diacritics."""
    low = F.lower(F.concat_ws(" ", "strong", "described", "body"))
    return bind(records, _low=folded(low) if fold else low)


def folded_terms(terms: Terms) -> Terms:
    return [(folded_text(w), [folded_text(a) for a in alts]) for w, alts in terms]


def holds(terms: Terms) -> Column:
    """Whether `_low` has the first word of an alternative of every term, as a plain substring: what a match must have."""
    keep = F.lit(True)
    for _, alts in terms:
        firsts = {query_words(a)[0] for a in alts if query_words(a)}
        keep = keep & F.greatest(*(F.contains("_low", F.lit(a)) for a in sorted(firsts)), F.lit(False))
    return keep


def candidates(records: DataFrame, terms: Terms, fold_diacritics: bool = False) -> DataFrame:
    """Records whose texts hold an alternative of every term somewhere, as plain substrings."""
    return texts(records, fold_diacritics).filter(holds(folded_terms(terms) if fold_diacritics else terms)).drop("_low")


def match(records: DataFrame, terms: Terms) -> DataFrame:
    """Records that hold an alternative of every term as whole words; a phrase must be in one of the texts."""
    names = ("_strong", "_described", "_body")
    keep = F.lit(True)
    for _, alts in terms:
        keep = keep & F.greatest(*(has(F.col(c), a) for c in names for a in alts), F.lit(False))
    found = bind(texts(records).filter(holds(terms)), **{f"_{c}": padded(F.coalesce(F.col(c), F.lit(""))) for c in ("strong", "described", "body")})
    return found.filter(keep).drop("_low", *names)


def squeezed(low: Column) -> Column:
    """padded() of a text that is in small letters."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, NOT_WORD, " ")), F.lit(" "))


def scored(records: DataFrame, terms: Terms) -> DataFrame:
    """records that every term matches, with their score. Texts are padded once, and only where the words occur at all."""
    if not terms:
        return records.withColumn("score", single(0.0)).filter("false")
    df = texts(records).filter(holds(terms))
    df = bind(df, **{f"_{c}": padded(F.coalesce(F.col(c), F.lit(""))) for c in ("strong", "described", "body")})
    df = bind(df, _wide=F.replace("_body", F.lit(" "), F.lit("  ")))
    each = []
    for _, alts in terms:
        place = F.greatest(
            *(
                F.when(has(F.col("_strong"), a), single(STRONG)).when(has(F.col("_described"), a), single(DESCRIBED)).otherwise(single(0.0))
                for a in alts
            ),
            single(0.0)
        )
        count = lambda n: F.when(n > 0, single(BODY) + single(REPEAT) * single(F.least(n, F.lit(4)) - 1)).otherwise(single(0.0))
        # Bound in a lambda, as the count is used twice.
        counts = F.array(F.greatest(*(wide_occurrences(F.col("_wide"), a) for a in alts), F.lit(0)))
        each.append(F.greatest(place, F.transform(counts, count)[0]))
    df = bind(df, _each=F.array(*each)).filter(F.forall("_each", lambda x: x > 0))
    score = F.aggregate("_each", single(0.0), lambda acc, x: acc + x)
    if len(terms) > 1:
        phrase = " ".join(w for w, _ in terms)
        both = F.greatest(*(has(F.col(c), phrase) for c in ("_strong", "_described", "_body")))
        score = F.when(both, score + single(PHRASE)).otherwise(score)
    return df.withColumn("score", score).drop("_low", "_each", "_strong", "_described", "_body", "_wide")


def tiered(found: DataFrame, keep: float = KEEP) -> DataFrame:
    """A written table of scored rows with their tier: best from `keep` of the top score on, else more."""
    top = found.agg(F.max("score").alias("_top"))
    return found.crossJoin(F.broadcast(top)).withColumn(
        "tier", F.when(F.col("score") >= F.col("_top") * single(keep), "best").otherwise("more")
    ).drop("_top")


def rank(records: DataFrame, terms: Terms, keep: float = KEEP) -> DataFrame:
    """id, score, tier (best or more) and rank within the tier: by score, then taken_at, both falling, then id. The texts are read once: what
    matches is written, without its texts, and sorted by ranges."""
    found = written(scored(records, terms).select("id", "score", "taken_at"))
    out = numbered(tiered(found, keep), "tier", F.desc("score"), F.desc("taken_at"), F.asc("id"))
    done_with(found)
    return out.select("id", "score", "tier", "rank")


def begins(words: list[str], every: bool = False) -> Column:
    """Whether the padded text `_every` has all words, the last one (or every one) as the beginning of a word."""
    keep = F.lit(bool(words))
    for k, w in enumerate(words):
        end = "" if every or k == len(words) - 1 else " "
        keep = keep & F.contains("_every", F.lit(f" {w}{end}"))
    return keep


def prefix_match(records: DataFrame, words: list[str], every: bool = False, fold_diacritics: bool = False) -> DataFrame:
    """Records with all words, the last one (or every one) as the beginning of a word."""
    if not words:
        return records.filter("false")
    words = [folded_text(w) for w in words] if fold_diacritics else words
    found = texts(records, fold_diacritics).filter(holds([(w, [w]) for w in words]))
    return bind(found, _every=squeezed(F.col("_low"))).filter(begins(words, every)).drop("_low", "_every")


def contained(query: str | Column, columns: tuple[str, ...]) -> Column:
    q = query if isinstance(query, Column) else F.lit(query)
    return F.greatest(*(F.coalesce(F.contains(F.lower(F.col(c)), q), F.lit(False)) for c in columns), F.lit(False))


def like(records: DataFrame, query: str, columns: tuple[str, ...] = ("body", "described", "strong"), limit: int | None = None) -> DataFrame:
    """Records with the query as a substring of a column, newest first. All of Unicode is compared without regard to case. limit: how
    many of the newest to return, where a caller wants no more."""
    q = query.strip().lower()
    if not q:
        return records.filter("false")
    found = records.filter(contained(q, columns)).orderBy(F.desc("taken_at"), "id")
    return found.limit(limit) if limit else found


def cascade(records: DataFrame, query: str, meanings: dict[str, list[str]] | None = None, fold_diacritics: bool = False) -> DataFrame:
    """id, stage, tier, rank: the precise ranking; if that is empty, word beginnings; if these are as well, substrings. A second pass over
    the texts, only where the first finds nothing, tells both; a record that begins words needs no look at substrings, as the least stage of
    all is the one that counts. fold_diacritics: word beginnings are found whatever the diacritics; ranking never folds. What is found is
    written without its texts."""
    terms, q = query_terms(query, meanings), query.strip().lower()
    words, kept = [folded_text(w) if fold_diacritics else w for w, _ in terms], ("id", "taken_at")
    scores = scored(records, terms).select(*kept, "score", F.lit(1).alias("stage"))
    beginning = holds([(w, [w]) for w in words]) if words else F.lit(False)
    inside = F.contains("_low", F.lit(folded_text(q) if fold_diacritics else q)) if q else F.lit(False)
    rest = bind(texts(records, fold_diacritics).filter(beginning | inside), _every=squeezed(F.col("_low")))
    stage = F.when(begins(words), 2).when(inside & contained(q, ("body", "described", "strong")), 3)
    rest = rest.select(*kept, single(0.0).alias("score"), stage.alias("stage")).filter("stage is not null")
    table = found = written(scores)
    if found.isEmpty():
        done_with(table)
        table = found = written(rest)
        found = found.join(F.broadcast(found.agg(F.min("stage").alias("stage"))), "stage").select(*found.columns)
    ranked = numbered(tiered(found), "tier", F.desc("score"), F.desc("taken_at"), F.asc("id"))
    done_with(table)
    out = ranked.select("id", "stage", "tier", "rank")
    out._written_at = ranked._written_at
    return out


def category_query(query: str) -> list[str]:
    """The categories that a query of one to three words asks for as a whole."""
    import regex

    ws = [w for w in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if w and w not in CATEGORY_FILLER]
    if not 1 <= len(ws) <= 3:
        return []
    return [c for c, names in CATEGORY_SYNONYMS.items() if all(w in names for w in ws) or CATEGORY_LABELS[c].lower() == query.strip().lower()]


def search(
    records: DataFrame, query: str, today: date | None = None, meanings: dict[str, list[str]] | None = None, radius: int = 48,
    fold_diacritics: bool = False
) -> DataFrame:
    """id, tier, rank, reason, snippet: whole categories first, then texts; a date in the query filters what was ranked, so it does
    not change which results count as best. records may have `categories` (array of strings)."""
    span, rest = parse_query(query, today or date.today())
    inside = records if span is None else records.filter((F.col("taken_at") >= F.lit(span[0])) & (F.col("taken_at") < F.lit(span[1])))
    best = F.lit("best").alias("tier")
    if span is not None and not rest:
        dated = numbered(inside.select("id", "taken_at", best), "tier", F.desc("taken_at"), F.asc("id"))
        return dated.select("id", "tier", "rank", F.lit("DATE").alias("reason"), F.lit(None).cast("string").alias("snippet"))
    asked = category_query(rest) if "categories" in records.columns else []
    found = cascade(records, rest, meanings, fold_diacritics)
    hits, used = found.select("id", "tier", F.lit(len(asked)).alias("part"), "rank", F.lit("TEXT").alias("reason")), [found]
    if asked:
        # A record of several asked categories comes once, with the first of them.
        wanted = F.array(*(F.lit(c) for c in asked))
        part = F.array_position(wanted, F.filter(wanted, lambda c: F.array_contains("categories", c))[0]) - 1
        whole = records.filter(F.arrays_overlap("categories", wanted)).select("id", "taken_at", best, part.cast("int").alias("part"))
        ranked = numbered(whole, "tier", F.desc("taken_at"), F.asc("id"))
        used.append(ranked)
        whole = ranked.select("id", "tier", "part", "rank", F.lit("CATEGORY").alias("reason"))
        hits = whole.unionByName(hits.join(whole.select("id"), "id", "left_anti"))
    words = [a for _, alts in query_terms(rest, meanings) for a in alts]
    shown = F.when(F.col("reason") == "TEXT", snippet(F.col("body"), words, radius)).alias("snippet")
    hits = hits.withColumnRenamed("rank", "place").join(inside.select("id", "body"), "id").select("id", "tier", "part", "place", "reason", shown)
    out = numbered(hits, "tier", F.asc("part"), F.asc("place"), F.asc("id"))
    done_with(*used)
    return out.select("id", "tier", "rank", "reason", "snippet")


def snippet(text: Column, terms: list[str], radius: int = 48) -> Column:
    """The text around the earliest hit of any term; edges reach out to white space, up to 16 characters further; null without a hit."""
    return snippet_at(text, F.array(*(F.lit(t) for t in terms)), radius) if terms else F.lit(None).cast("string")


def snippet_at(text: Column, terms: Column, radius: int = 48) -> Column:
    """snippet() of the terms (array of strings) of a row."""
    far, low = radius + 16, F.lower(text)
    places = F.transform(terms, lambda t: F.position(t, low))
    hit = F.array_min(F.filter(places, lambda p: p > 0)) - 1  # from 0
    size = F.length(text)
    # Left edge: the nearest white space within reach to the left of hit - radius, else as far as allowed; the right one alike.
    left0, right0 = F.greatest(hit - radius, F.lit(0)), F.least(hit + radius, size)
    reach_l = F.greatest(hit - far, F.lit(0))
    before = F.substring(text, reach_l + 1, left0 - reach_l)
    start = left0 - F.length(F.regexp_extract(before, r"(\S*)\z", 1))  # \z: a line end is white space as well
    reach_r = F.least(hit + far, size)
    after = F.substring(text, right0 + 1, reach_r - right0)
    end = right0 + F.length(F.regexp_extract(after, r"^(\S*)", 1))
    core = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), r"\s+", " "))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), core, F.when(end < size, "…").otherwise(""))
    return F.when(hit.isNotNull() & (F.trim(flat(text)) != ""), cut)


def clean_query(query: str) -> str:
    return basic_clean(query).lower()


def token_table(records: DataFrame, columns: tuple[str, ...] = ("strong", "described", "body")) -> DataFrame:
    """(id, col, pos, tok): the inverted index, to be written bucketed by `tok` where many queries run over one table."""
    from ..functions.text import words_of

    parts = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in columns))
    rows = records.select("id", F.explode(parts).alias("p")).select("id", "p.col", F.posexplode(words_of(F.col("p.text"))).alias("pos", "tok"))
    return rows


def match_by_tokens(tokens: DataFrame, terms: Terms) -> DataFrame:
    """ids that hold an alternative of every term, by way of the inverted index. A phrase needs its words one after another in one column."""
    spark = tokens.sparkSession
    alternatives = [(k, n, query_words(a)) for k, (_, alts) in enumerate(terms) for n, a in enumerate(alts)]
    wanted = spark.createDataFrame([(k, n, i, len(ws), w) for k, n, ws in alternatives for i, w in enumerate(ws)], "term int, alt int, at int, size int, tok string")  # a query's words
    met = tokens.join(F.broadcast(wanted), "tok").groupBy("id", "col", (F.col("pos") - F.col("at")).alias("begin"), "term", "alt").agg(
        F.count_distinct("at").alias("n"), F.first("size").alias("size")
    )
    hits = met.filter(F.col("n") == F.col("size")).groupBy("id").agg(F.count_distinct("term").alias("n"))
    return hits.filter(F.col("n") == len(terms)).select("id")

"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

The seeds are the base matches: e-mail addresses, IP addresses, card and phone numbers. From the words around them come
lexical patterns, in lower case without marks, with the kind of the seed: the two words before an identifier-like word (one with a digit
or an @), the two after it, and one on either side. Patterns and the instances that they enclose form a bipartite graph with their counts.
Scores go back and forth over it a fixed number of times: a pattern's confidence in a kind is the mean score of all the instances that it
encloses; an instance's score in a kind is that of its best pattern (a seed's stays 1). Words without a base
match that a high-confidence pattern with enough different instances encloses are added, with the pattern's kind.

Offsets are in code points: the gaps of split() and the matches of regexp_extract_all() alternate in a text, so running sums
of their lengths give each match its place. The patterns are written so that the JVM neither backtracks nor recurses on
long texts, with the same matches as the plain forms.

Defined results: null and empty texts have no spans; texts of any length are read whole; repeated rows (also repeated ids) are told
apart and each has its result; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import finish, save

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the kind.
HINTS = {"email": "@", "ip": None, "card": None, "phone": "+"}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    size = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0),
        lambda acc, k: acc + F.when((size - k) % 2 == 0, F.substring(number, k, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(number, k, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        bare_part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(
            F.split(match, r"\."), lambda p: (F.length(bare_part(p)) <= 3) & F.coalesce(bare_part(p).try_cast("int") <= 255, F.lit(False))
        )
    if kind == "card":
        n = digits(match)
        return F.when(F.length(n).between(12, 19), luhn(n)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def places(lengths: Column, step: int = 512) -> Column:
    """The sum of all lengths before each. Summed in parts of `step`, as appending to an array copies it."""
    empty, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")

    def own(at: Column, part: Column) -> Column:
        start = F.struct(at.alias("at"), empty.alias("out"))
        return F.aggregate(part, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))

    parts = once(
        lengths,
        lambda ns: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ns) - 1, F.lit(0)), F.lit(step)), lambda k: F.slice(ns, k + 1, F.lit(step)))
    )
    whole = F.aggregate(
        parts, F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda a, part: once(own(a["at"], part), lambda x: F.struct(x["at"].alias("at"), F.array_append(a["out"], x["out"]).alias("out")))
    )
    return F.flatten(whole["out"])


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end, value>> of the valid matches of a kind, in order."""
    pattern = PATTERNS[kind]
    empty = F.lit(None).cast("array<struct<start:long,kind:int,end:long,value:string>>")
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))  # a gap more than matches

    def spans(xs: Column) -> Column:
        at = places(F.transform(xs, lambda x: (F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("long")))
        cut = F.zip_with(
            xs, at,
            lambda x, a: F.struct(
                (a + F.length(x["g"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (a + F.length(x["g"]) + F.length(x["m"])).alias("end"),
                x["m"].alias("value")
            )
        )
        return F.filter(cut, lambda s: s["value"].isNotNull() & valid(kind, s["value"]))

    hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else F.lit(True)
    return F.coalesce(
        F.when(hint & text.rlike(pattern), once(both, spans)), empty, F.array().cast("array<struct<start:long,kind:int,end:long,value:string>>")
    )


def words_like(text: Column) -> Column:
    """array<struct<start, end, word, patterns>> of the identifier-like words, with the patterns that enclose them."""

    def around(ws: Column) -> Column:
        near = lambda i, k: F.coalesce(bare(F.get(ws, i + k)["word"]), F.lit(""))
        sides = lambda i: {"before": [near(i, -2), near(i, -1)], "after": [near(i, 1), near(i, 2)], "around": [near(i, -1), near(i, 1)]}
        patterns = lambda i: F.array(*(F.concat_ws(" ", F.lit(name), *parts) for name, parts in sides(i).items()))
        like = F.filter(
            F.transform(
                ws, lambda x, i: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["word"])).alias("end"), x["word"].alias("word"), i.alias("i"))
            ),
            lambda x: x["word"].rlike("[0-9@]")
        )
        return F.transform(
            like, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word"), patterns(x["i"]).alias("patterns"))
        )

    def placed(ws: Column) -> Column:
        at = places(F.transform(ws, lambda w: (F.length(w) + 1).cast("long")))  # one separator each
        return F.filter(F.zip_with(ws, at, lambda w, a: F.struct(w.alias("word"), a.alias("at"))), lambda x: x["word"] != "")

    return once(once(F.split(text, r"[\x20\x09-\x0D]", -1), placed), around)


def seeded(table: DataFrame) -> DataFrame:
    """(row, start, end, instance, patterns, kind): the identifier-like words of table (row, base, text), with the kind of the base match
    that they overlap, the first in KINDS of several, null without one. Words and base matches of a text are settled by one sweep over their
    places, as rows: no row holds more than a word, and the time is linear in both. Words of texts without base matches skip it."""
    some = F.size("base") > 0
    words = table.filter("text is not null").select("row", some.alias("some"), F.explode(words_like(F.col("text"))).alias("w")).select(
        "row", "some", "w.start", "w.end", bare(F.col("w.word")).alias("instance"), "w.patterns"
    )
    spans = table.filter(some).select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end", "b.kind")
    # A match counts for a word if it begins before the word's end (so at the same place words come first) and ends after its start.
    # Matches of one kind don't overlap, so of those that began the last one ends last.
    events = words.filter("some").drop("some").withColumns({"pos": F.col("end"), "late": F.lit(0)}).unionByName(
        spans.withColumns({"pos": F.col("start"), "late": F.lit(1)}), allowMissingColumns=True
    )
    sweep = Window.partitionBy("row").orderBy("pos", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = [F.max(F.when(F.col("kind") == k, F.col("end"))).over(sweep).alias(f"reach{k}") for k in range(len(KINDS))]
    swept = events.select("row", "start", "end", "instance", "patterns", "late", *reach).filter("late = 0")
    kind = F.coalesce(*(F.when(F.col(f"reach{k}") > F.col("start"), F.lit(k)) for k in range(len(KINDS))))
    columns = ["row", "start", "end", "instance", "patterns"]
    return swept.select(*columns, kind.alias("kind")).unionByName(words.filter("not some").select(*columns, F.lit(None).cast("int").alias("kind")))


def bare(c: Column) -> Column:
    """The letters and digits of a word, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def extract(docs: DataFrame, id_col: str, text_col: str, rounds: int = 3, least: float = 0.85, different: int = 4) -> DataFrame:
    """For each row: its id and spans (array of start, kind, end, base, score; by start, then kind). least: the confidence that a
    pattern needs to discover, different: how many different instances it must have enclosed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    base = F.flatten(F.array(*(matches(F.col("text"), k) for k in KINDS)))
    numbers = F.col("text").rlike("[0-9@]")
    # Texts with an identifier-like word are kept with the spans: the second pass reads nothing else.
    table = src.select(
        F.monotonically_increasing_id().alias("row"), "id",
        F.when(numbers, base).otherwise(F.array().cast("array<struct<start:long,kind:int,end:long,value:string>>")).alias("base"),
        F.when(numbers, F.col("text")).alias("text"),
    )
    table = save(table, "pii")
    edges = seeded(table).select("row", "start", "end", "instance", F.explode("patterns").alias("pattern"), "kind", F.col("kind").isNotNull().alias("seed"))
    edges = save(edges.filter((F.col("instance") != "") & ~F.col("pattern").rlike("^[a-z]+ *$")), "pii-edges")  # a pattern of no words tells nothing
    used = [table, edges]  # what nothing reads once the result is written
    scored = score(edges, rounds, different, used)
    found = edges.filter("not seed").join(scored.filter(F.col("score") >= least), "pattern").groupBy("row", "start", "end").agg(
        F.max(F.struct("score", F.col("to").alias("kind"))).alias("s")
    )
    found = found.groupBy("row").agg(
        F.collect_list(
            F.struct("start", F.col("s.kind").alias("kind"), "end", F.lit(False).alias("base"), F.col("s.score").alias("score"))
        ).alias("more")
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    whole = table.select(
        "row", "id",
        F.transform(
            "base",
            lambda s: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(True).alias("base"), F.lit(1.0).alias("score")
            )
        ).alias("own")
    )
    out = whole.join(found, "row", "left")
    spans = F.array_sort(
        F.when(F.col("more").isNull(), F.col("own")).otherwise(F.concat("own", F.coalesce("more", F.array().cast(found.schema["more"].dataType))))
    )
    out = out.select(
        F.col("id").alias(id_col),
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end"), s["base"].alias("base"),
                s["score"].alias("score")
            )
        ).alias("spans")
    )
    return finish(out, *used)


def score(edges: DataFrame, rounds: int, different: int, used: list[DataFrame]) -> DataFrame:
    """(pattern, to, score): a pattern's confidence in each kind after so many rounds over the graph of patterns and instances."""
    graph = edges.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    graph = save(graph, "pii-graph")
    used.append(graph)
    kinds = F.explode(F.array(*(F.lit(k) for k in range(len(KINDS)))))
    belief = graph.filter("kind is not null").select("instance", F.col("kind").alias("to"), F.lit(1.0).alias("belief")).distinct()
    seeds = belief
    total = graph.groupBy("pattern").agg(F.count("*").alias("all"))
    pattern = None
    for k in range(rounds):
        pattern = graph.join(belief, "instance").groupBy("pattern", "to").agg(
            F.sum("belief").alias("s"), F.count("*").alias("c")
        ).join(total, "pattern")
        # Laplace's rule: a pattern seen a few times is never sure.
        pattern = pattern.select("pattern", "to", (F.col("s") / (F.col("all") + 0.5)).alias("score"), "all").filter(
            (F.col("all") >= different) & (F.col("score") >= 0.5)
        )
        if k + 1 < rounds:
            pattern = save(pattern, "pii-patterns")
            used.append(pattern)
            reach = graph.filter("kind is null").join(pattern, "pattern").groupBy("instance", "to").agg(F.max("score").alias("belief"))
            belief = seeds.unionByName(reach)
    return pattern.select("pattern", "to", "score")

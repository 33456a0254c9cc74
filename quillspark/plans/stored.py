"""Registered queries over the stored index, tables of queries, and lookups by ranges, each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dictionaries import FILLER
from ..operators import index, many
from ..streaming import live
from ..shared import shared_dir
from ..sources.versions import Versions
from . import reads, writes
from .queries import _PAD, ORACLE_SQL, QUERIES, TODAY, rank_sql, records, search_records, table

_built: dict[tuple[str, str, bool], index.Index] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def index_of(spark: SparkSession, sf_dir: str, grams: bool = False) -> index.Index:
    """The index of the search records of a folder of tables: built once a session, then only read. grams: one that knows substrings, which costs several
    times as much to build."""
    key = spark.sparkContext.applicationId, sf_dir, grams
    if key not in _built:
        _built[key] = index.build(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", search_records(spark, sf_dir), grams)
    return _built[key]


def _score(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(F.col("score") * 10).cast("int").alias("score10"), "tier", "rank")


@query(rank_sql("ther than"))
def index_rank(spark, sf_dir):
    return _score(index_of(spark, sf_dir).rank(tx.query_terms("ther than")))


@query(f"SELECT * FROM ({rank_sql('src3 the erin')}) WHERE tier = 'best'")
def index_best(spark, sf_dir):
    return _score(index_of(spark, sf_dir).best(tx.query_terms("src3 the erin")))


@query(
    rf"SELECT doc_id AS id FROM documents WHERE contains({_PAD.format("source || '  ' || text")}, ' ther ') AND contains({_PAD.format("source || '  ' || text")}, ' erin')"
)
def index_prefix(spark, sf_dir):
    return index_of(spark, sf_dir).prefix(["ther", "erin"])


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'er the') OR contains(lower(source), 'er the')")
def index_like(spark, sf_dir):
    return index_of(spark, sf_dir, grams=True).like(search_records(spark, sf_dir), " ER the ").select("id")


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'q') OR contains(lower(source), 'q')")
def index_like_short(spark, sf_dir):
    return index_of(spark, sf_dir, grams=True).like(search_records(spark, sf_dir), "Q").select("id")


@query(
    r"""SELECT term, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')) || ' ' || lower(coalesce(source, '')), '[\p{L}\p{M}\p{N}]+'))) AS term FROM documents)
WHERE starts_with(term, 'eri') GROUP BY term"""
)
def index_dictionary(spark, sf_dir):
    return index_of(spark, sf_dir).dictionary("eri")


_EDITED = """(SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN lang || ' ther, than ' || source ELSE text END AS text, CASE WHEN doc_id % 10 = 3 THEN 'than' ELSE source END AS source
FROM documents WHERE doc_id % 10 <> 7 UNION ALL SELECT doc_id + 10000000, text || ' ther ther than', 'new' FROM documents WHERE doc_id % 50 = 1)"""


@query(rank_sql("ther than", _EDITED))
def index_after_edits(spark, sf_dir):
    """Records changed, deleted and added in two deltas, the deltas merged."""
    docs = search_records(spark, sf_dir)
    ix = index.build(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", docs, grams=False)
    body = F.concat(F.col("categories")[0], F.lit(" ther, than "), "strong")
    changed = docs.filter("id % 10 = 3").withColumn("body", body).withColumn("strong", F.lit("than"))
    ix = ix.changed(changed, docs.filter("id % 10 = 7").select("id"))
    new = docs.filter("id % 50 = 1").select(
        (F.col("id") + 10_000_000).alias("id"), F.lit("new").alias("strong"), "described", F.concat("body", F.lit(" ther ther than")).alias("body"),
        F.timestamp_seconds((F.col("id") + 10_000_000) * 3600).alias("taken_at"), "categories"
    )
    return _score(ix.changed(new).merged().rank(tx.query_terms("ther than")))


@query(rank_sql("ther than", "(SELECT doc_id, text, source || ' ' || lang AS source FROM documents WHERE doc_id % 3 = 0)"))
def sync_indexed(spark, sf_dir):
    """A store of every second record after a listing of every third: the ranking by its index, which only knows what came and went."""
    own = records(spark, sf_dir).withColumn("objects", F.array().cast("array<string>"))
    store = Versions(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    items = own.select(F.lit(1).cast("long").alias("collection_id"), F.col("id").alias("record_id"), F.col("taken_at").alias("added_at"))
    writes.found_store(store, own.filter("id % 2 = 0"), items, grams=False)
    version, _, _ = writes.sync_store(store, own.filter("id % 3 = 0"))
    return _score(index.Index(store, version).rank(tx.query_terms("ther than")))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four queries of each passage: its words, two of them with the second cut short, letters across their border, and two with a month."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(f"({tx.WORD})"), F.lit(1)).alias("w"))
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    asked = F.array(
        F.array_join("w", " "), F.concat_ws(" ", first, F.expr("left(get(w, 1), length(get(w, 1)) - 1)")),
        F.concat(F.expr("right(get(w, 0), 2)"), F.lit(" "), F.expr("left(get(w, 1), 1)")), F.concat(first, F.lit(" "), second, F.lit(" february 1970"))
    )
    return b.select("item_id", F.posexplode(asked).alias("k", "text")).select((F.col("item_id") * 4 + F.col("k")).alias("q"), "text")


_FORM = r"""CASE WHEN length(w) < 3 OR regexp_matches(w, '[0-9]') THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y'
WHEN w LIKE '%ches' OR w LIKE '%shes' OR w LIKE '%xes' OR w LIKE '%sses' THEN left(w, length(w) - 2) WHEN w LIKE '%ss' THEN w || 'es' WHEN w LIKE '%s' THEN left(w, length(w) - 1)
WHEN w LIKE '%y' AND length(w) > 3 AND NOT contains('aeiou', substring(w, length(w) - 1, 1)) THEN left(w, length(w) - 1) || 'ies' WHEN w LIKE '%ch' OR w LIKE '%sh' OR w LIKE '%x' THEN w || 'es' ELSE w || 's' END"""

#: Stage 1 by whole words with their other form, stage 2 by word beginnings, stage 3 by substrings, each for the queries that the ones before
#: found nothing for; ranks within the span of days, if there is one.
_MANY = rf"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM benchmark),
q0 AS (SELECT item_id * 4 AS q, array_to_string(w, ' ') AS rest, false AS dated FROM b UNION ALL SELECT item_id * 4 + 1, w[1] || ' ' || left(w[2], length(w[2]) - 1), false FROM b
UNION ALL SELECT item_id * 4 + 2, right(w[1], 2) || ' ' || left(w[2], 1), false FROM b UNION ALL SELECT item_id * 4 + 3, w[1] || ' ' || w[2], true FROM b), q AS (SELECT q, trim(rest) AS rest, dated FROM q0),
u AS (SELECT q, unnest(string_split(rest, ' ')) AS w, unnest(range(1, len(string_split(rest, ' ')) + 1)) AS i FROM q),
v AS (SELECT * FROM u WHERE w NOT IN {FILLER} OR q NOT IN (SELECT q FROM u WHERE w NOT IN {FILLER})),
t AS (SELECT q, w, row_number() OVER (PARTITION BY q ORDER BY min(i)) AS k FROM v GROUP BY q, w), n AS (SELECT q, max(k) AS n, string_agg(w, ' ' ORDER BY k) AS phrase FROM t GROUP BY q),
a AS (SELECT q, k, w AS tok FROM t UNION SELECT q, k, {_FORM} FROM t),
f AS (SELECT doc_id AS id, tok, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS tok FROM documents) GROUP BY ALL),
o AS (SELECT id, tok, (1::FLOAT + 0.2::FLOAT * (least(c, 4) - 1)::FLOAT)::FLOAT AS s FROM f UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(source), '[\p{{L}}\p{{M}}\p{{N}}]+'))), 3::FLOAT FROM documents),
m AS (SELECT q, k, id, max(s) AS s FROM a JOIN o USING (tok) GROUP BY ALL),
s AS (SELECT m.q, m.id, list_reduce(list(s ORDER BY k), lambda x, y: (x + y)::FLOAT)::FLOAT AS s FROM m JOIN n ON m.q = n.q GROUP BY m.q, m.id, n.n HAVING count(*) = n.n),
d AS (SELECT doc_id AS id, {_PAD.format("source")} AS p, {_PAD.format("text")} AS b FROM documents),
s1 AS (SELECT s.q, s.id, CASE WHEN n.n > 1 AND (contains(d.b, ' ' || phrase || ' ') OR contains(d.p, ' ' || phrase || ' ')) THEN (s + 1.5::FLOAT)::FLOAT ELSE s END AS s FROM s JOIN n ON s.q = n.q JOIN d ON s.id = d.id),
z AS (SELECT DISTINCT tok FROM o), e AS (SELECT t.q, t.k, z.tok FROM t JOIN n ON t.q = n.q JOIN z ON (t.k < n.n AND z.tok = t.w) OR (t.k = n.n AND starts_with(z.tok, t.w)) WHERE t.q NOT IN (SELECT q FROM s1)),
s2 AS (SELECT e.q, o.id, 0::FLOAT AS s FROM e JOIN o ON e.tok = o.tok JOIN n ON e.q = n.q GROUP BY e.q, o.id, n.n HAVING count(DISTINCT e.k) = n.n),
s3 AS (SELECT q.q, doc_id AS id, 0::FLOAT AS s FROM q JOIN documents ON contains(lower(text), rest) OR contains(lower(source), rest) WHERE q NOT IN (SELECT q FROM s1) AND q NOT IN (SELECT q FROM s2)),
h AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
r AS (SELECT *, CASE WHEN s >= (max(s) OVER (PARTITION BY q)) * 0.6::FLOAT THEN 'best' ELSE 'more' END AS tier FROM h)
SELECT r.q, r.id, tier, (row_number() OVER (PARTITION BY r.q, tier ORDER BY s DESC, r.id DESC))::INT AS rank, 'TEXT' AS reason FROM r JOIN q ON r.q = q.q
WHERE NOT dated OR (r.id * 3600 >= epoch(TIMESTAMP '1970-02-01') AND r.id * 3600 < epoch(TIMESTAMP '1970-03-01'))"""


@query(_MANY)
def many_queries(spark, sf_dir):
    """All queries of the benchmark's passages at once, each with its own stage of the cascade."""
    found = many.search(index_of(spark, sf_dir, grams=True), benchmark_queries(spark, sf_dir), search_records(spark, sf_dir), TODAY, radius=None)
    return found.select("q", "id", "tier", "rank", "reason")


@query(
    """SELECT o_orderkey AS id, e.ts AS event_at, e.event_id FROM orders o ASOF LEFT JOIN (SELECT ts, max(event_id) AS event_id FROM events GROUP BY ts) e ON o.o_orderdate >= e.ts"""
)
def orders_as_of_events(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), "event_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    return reads.as_of(orders, marks, "at", "event_id", "event_id").select("id", F.col("mark_at").alias("event_at"), "event_id")


@query(
    "SELECT c AS category, count(*) AS n FROM (SELECT unnest(CASE WHEN doc_id % 10 = 3 THEN ['edited', lang] ELSE [lang, source] END) AS c FROM documents WHERE doc_id % 10 <> 7) GROUP BY c"
)
def category_counts_after_edits(spark, sf_dir):
    """Counts from what came in and what went, not from the table after the edits."""
    r = records(spark, sf_dir)
    gone = live.retractions(r.filter("id % 10 = 7 or id % 10 = 3"), r.limit(0))
    new = live.retractions(r.limit(0), r.filter("id % 10 = 3").withColumn("categories", F.array(F.lit("edited"), "note")))
    every = live.retractions(r.limit(0), r).unionByName(gone).unionByName(new)
    return live.count_changes(every).filter("part = 'category' and n <> 0").select(F.col("name").alias("category"), "n")


@query(
    f"""WITH k AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM benchmark)
SELECT item_id AS id, array_to_string(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i AND (x NOT IN {FILLER} OR len(list_filter(w, lambda y: y NOT IN {FILLER})) = 0)), lambda w: w || CASE WHEN {_FORM} <> w THEN '|' || {_FORM} ELSE '' END), ' ') AS terms FROM k"""
)
def query_term_forms(spark, sf_dir):
    """The terms of every passage as a query, with their other forms."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(f"({tx.WORD})"), F.lit(1)), " ").alias("text"))
    rows = many.parsed(asked, TODAY).select("q", F.explode(F.filter("wanted", lambda w: w["k"] >= 0)).alias("w")).select("q", "w.k", "w.alt", "w.word")
    terms = rows.groupBy("q", "k").agg(F.array_sort(F.collect_list(F.struct("alt", "word"))).alias("a"))
    words = terms.select("q", "k", F.array_join(F.transform("a", lambda x: x["word"]), "|").alias("t"))
    return words.groupBy(F.col("q").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), " ").alias("terms"))

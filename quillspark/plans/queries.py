"""Registered queries: the library's operators over the driver's tables, each with DuckDB SQL where SQL can say the same.

Roles: documents are records (id = doc_id; an hour apart by id, for want of a time), their source is the app and their
language the note; labels mark favourites; customers are collections and orders their items; events have times and states.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dictionaries import APP_PHRASES, CAPTURE_FOLDER, CATEGORY_APPS, CATEGORY_KEYWORDS, ENTITY_PATTERNS, HTML_NAMES
from ..operators import captions, classify, entities, layout, search
from ..shared import small_batches
from ..sources import store
from . import enrich, reads, writes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = date(2026, 10, 3)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(keys: DataFrame, key: str) -> DataFrame:
    """Keys spread over all cores, before much is worked out of each: a small file is one task's, however much work its rows make."""
    spark = keys.sparkSession
    return keys.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(marks, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(
            F.lit("doc/"), F.col("doc_id")
        ).alias("uri"), F.timestamp_seconds(F.col("doc_id") * 3600).alias("taken_at"),
        (F.col("doc_id") % 3).cast("int").alias("state"), (F.col("doc_id") % 4).cast("int").alias("attempts"), F.col("text").alias("ocr_text"), F.col("lang").alias("note"),
        F.col("source").alias("app"), F.when(
            F.col("doc_id") % 2 == 0, "user"
        ).otherwise("usage").alias("app_source"), F.lit(None).cast("string").alias("app_package"),
        F.lit(None).cast("string").alias("page_url"), F.lit(None).cast("string").alias("headline"), F.lit(None).cast("string").alias("description"),
        F.array("lang", "source").alias("categories"), F.array(
            "lang", F.lit(""), "lang"
        ).alias("objects"), F.array().cast(entities.TYPE).alias("entities"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("favorite"), (F.col("n_chars") < 500).alias("ocr_pending"), F.lit(0).alias("index_version"), (F.col("doc_id") % 2).cast("int").alias("describe_version"),
    )


#: The same records for DuckDB.
R = """WITH r AS (SELECT d.doc_id AS id, 'doc/' || d.doc_id AS uri, d.doc_id * 3600 AS taken_s, d.doc_id % 3 AS state, d.doc_id % 4 AS attempts, d.text AS ocr_text, d.lang AS note,
d.source AS app, CASE WHEN d.doc_id % 2 = 0 THEN 'user' ELSE 'usage' END AS app_source, coalesce(l.toxic = 1, false) AS favorite, d.n_chars < 500 AS ocr_pending, d.doc_id % 2 AS describe_version, d.lang, d.source
FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("strong"), F.lit("").alias("described"), F.col("text").alias("body"),
        F.timestamp_seconds(F.col("doc_id") * 3600).alias("taken_at"), F.array("lang").alias("categories")
    )


_PAD = r"' ' || trim(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')) || ' '"
_COUNT = "((length(w) - length(replace(w, ' {0} ', ''))) / length(' {0} '))::INT"


def rank_sql(query_text: str, source: str = "documents") -> str:
    terms = tx.query_terms(query_text)
    each = []
    for _, alts in terms:
        strong = " OR ".join(f"contains(s, ' {a} ')" for a in alts)
        n = "greatest(0, " + ", ".join(_COUNT.format(a) for a in alts) + ")"
        each.append(
            f"greatest(CASE WHEN {strong} THEN 3::FLOAT ELSE 0::FLOAT END, CASE WHEN {n} > 0 THEN 1::FLOAT + 0.2::FLOAT * (least({n}, 4) - 1)::FLOAT ELSE 0::FLOAT END)"
        )
    names = [f"t{k}" for k in range(len(each))]
    phrase = " ".join(w for w, _ in terms)
    bonus = f" + CASE WHEN contains(s, ' {phrase} ') OR contains(b, ' {phrase} ') THEN 1.5::FLOAT ELSE 0::FLOAT END" if len(terms) > 1 else ""
    return f"""WITH p AS (SELECT doc_id AS id, {_PAD.format("source")} AS s, {_PAD.format("text")} AS b FROM {source}),
w AS (SELECT *, replace(b, ' ', '  ') AS w FROM p), e AS (SELECT id, s, b, {", ".join(f"{x} AS {n}" for x, n in zip(each, names, strict=True))} FROM w),
f AS (SELECT id, (0::FLOAT + {" + ".join(names)}{bonus})::FLOAT AS score FROM e WHERE {" AND ".join(f"{n} > 0" for n in names)}),
t AS (SELECT *, CASE WHEN score >= (SELECT max(score) FROM f) * 0.6::FLOAT THEN 'best' ELSE 'more' END AS tier FROM f)
SELECT id, round(score * 10)::INT AS score10, tier, (row_number() OVER (PARTITION BY tier ORDER BY score DESC, id DESC))::INT AS rank FROM t"""


def ranked(spark: SparkSession, sf_dir: str, query_text: str) -> DataFrame:
    return search.rank(search_records(spark, sf_dir), tx.query_terms(query_text)).select(
        "id", F.round(F.col("score") * 10).cast("int").alias("score10"), "tier", "rank"
    )


@query(rank_sql("ther than"))
def search_two_terms(spark, sf_dir):
    return ranked(spark, sf_dir, "ther than")


@query(rank_sql("erin"))
def search_one_term(spark, sf_dir):
    return ranked(spark, sf_dir, "show my photos of erin")


@query(rank_sql("src3 the erin"))
def search_three_terms(spark, sf_dir):
    return ranked(spark, sf_dir, "src3 the erin")


@query(
    rf"SELECT doc_id AS id FROM documents WHERE contains({_PAD.format("source || '  ' || text")}, ' ther ') AND contains({_PAD.format("source || '  ' || text")}, ' erin')"
)
def search_prefix(spark, sf_dir):
    return search.prefix_match(search_records(spark, sf_dir), ["ther", "erin"]).select("id")


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'er the') OR contains(lower(source), 'er the')")
def search_like(spark, sf_dir):
    return search.like(search_records(spark, sf_dir), " ER the ").select("id")


@query(
    rf"SELECT doc_id AS id FROM documents WHERE (contains({_PAD.format("source || '  ' || text")}, ' ther ') OR contains({_PAD.format("source || '  ' || text")}, ' thers ')) AND (contains({_PAD.format("source || '  ' || text")}, ' than ') OR contains({_PAD.format("source || '  ' || text")}, ' thans '))"
)
def match_tokens(spark, sf_dir):
    return search.match_by_tokens(search.token_table(search_records(spark, sf_dir)), tx.query_terms("ther than"))


@query("SELECT doc_id AS id, 3 AS stage FROM documents WHERE contains(lower(text), 'rin er') OR contains(lower(source), 'rin er')")
def search_cascade(spark, sf_dir):
    return search.cascade(search_records(spark, sf_dir), "rin er").select("id", "stage")


def snippet_sql(text: str, terms: list[str], radius: int = 48) -> str:
    """The text around the earliest hit of a term, for DuckDB; null without a hit."""
    hit = "list_min(list_filter([" + ", ".join(f"strpos(lower({text}), '{t}')" for t in terms) + "], lambda p: p > 0)) - 1"
    far = radius + 16
    return rf"""(SELECT CASE WHEN b > 0 THEN '…' ELSE '' END || trim(regexp_replace(substring({text}, (b + 1)::INT, (e - b)::INT), '\s+', ' ', 'g')) || CASE WHEN e < n THEN '…' ELSE '' END
FROM (SELECT n, l - length(regexp_extract(substring({text}, (greatest(h - {far}, 0) + 1)::INT, (l - greatest(h - {far}, 0))::INT), '(\S*)$', 1)) AS b, r + length(regexp_extract(substring({text}, (r + 1)::INT, (least(h + {far}, n) - r)::INT), '^(\S*)', 1)) AS e
FROM (SELECT h, n, greatest(h - {radius}, 0) AS l, least(h + {radius}, n) AS r FROM (SELECT {hit} AS h, length({text}) AS n))) WHERE b IS NOT NULL)"""


def combined_sql(query_text: str, start: str, end: str) -> str:
    """Texts of a span of time: ranked among all, then numbered within the span."""
    words = [a for _, alts in tx.query_terms(query_text) for a in alts]
    return f"""WITH q AS ({rank_sql(query_text)}), d AS (SELECT q.id, q.tier, q.rank AS place, x.text FROM q JOIN documents x ON q.id = x.doc_id WHERE q.id * 3600 >= epoch(TIMESTAMP '{start}') AND q.id * 3600 < epoch(TIMESTAMP '{end}'))
SELECT id, tier, (row_number() OVER (PARTITION BY tier ORDER BY place))::INT AS rank, 'TEXT' AS reason, {snippet_sql("text", words)} AS snippet FROM d"""


@query(combined_sql("ther than", "1970-02-01", "1970-03-01"))
def search_combined(spark, sf_dir):
    return search.search(search_records(spark, sf_dir), "ther than february 1970", TODAY)


@query(
    r"""SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), lambda x: x IN ('ther', 'thers'))) + len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), lambda x: x IN ('erin', 'erins'))) AS hits FROM documents"""
)
def word_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), tx.word_hits(F.col("text"), ["ther", "erin"]).cast("long").alias("hits")
    )


@query(
    f"SELECT id, snippet FROM (SELECT doc_id AS id, {snippet_sql('text', ['erin', 'erins'])} AS snippet FROM documents WHERE contains(lower(text), 'erin')) WHERE snippet IS NOT NULL"
)
def snippets(spark, sf_dir):
    d = search.candidates(search_records(spark, sf_dir), tx.query_terms("erin"))
    return d.select("id", search.snippet(F.col("body"), ["erin", "erins"]).alias("snippet")).filter("snippet is not null")


@query(f"{R} SELECT id, uri FROM r")
def all_records(spark, sf_dir):
    return reads.newest(records(spark, sf_dir)).select("id", "uri")


@query(f"{R} SELECT id FROM r WHERE lang = 'fr' OR source = 'fr'")
def category_records(spark, sf_dir):
    return reads.in_category(records(spark, sf_dir), "fr").select("id")


@query(f"{R} SELECT id FROM r WHERE favorite")
def favorite_records(spark, sf_dir):
    return reads.favorites(records(spark, sf_dir)).select("id")


def _items(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("added_at")
    )


def _ordered(spark, sf_dir):
    """Orders as records; finished ones are gone."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("order/"), F.col("o_orderkey")).alias("uri"), F.col("o_totalprice").alias("price"),
        F.array(F.col("o_orderpriority")).alias("objects"), F.col("o_orderstatus").alias("description")
    )


def _names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F' AND o_custkey = 7")
def collection_items(spark, sf_dir):
    return reads.collection_records(_ordered(spark, sf_dir), _items(spark, sf_dir), 7).select("id", "price")


_SUMMARY = """SELECT c_custkey AS id, c_name AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n,
(SELECT max_by('order/' || o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') AS cover FROM customer"""


@query(_SUMMARY)
def collection_summary(spark, sf_dir):
    return reads.collections(_names(spark, sf_dir), _items(spark, sf_dir), _ordered(spark, sf_dir))


@query(f"SELECT * FROM ({_SUMMARY}) WHERE id = 7")
def collection_one(spark, sf_dir):
    return collection_summary(spark, sf_dir).filter("id = 7")


@query(
    "SELECT o.o_orderkey AS id, c.c_name || ':' || (SELECT count(*) FROM orders x WHERE x.o_custkey = c.c_custkey) AS collections FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F')"
)
def record_detail(spark, sf_dir):
    mine = _ordered(spark, sf_dir)
    out = reads.detail(mine, _names(spark, sf_dir), _items(spark, sf_dir), mine.agg(F.min("id").alias("id")))
    return out.select("id", F.array_join(F.transform("collections", lambda c: F.concat_ws(":", c["name"], c["n"])), ",").alias("collections"))


@query(
    f"{R} SELECT count(*) AS total, count_if(state = 1) AS indexed, count_if(state = 0) AS pending, count_if(state = 2) AS failed, count_if(ocr_pending) AS ocr_pending, count_if(favorite) AS favorites FROM r"
)
def state_counts(spark, sf_dir):
    return reads.counts(records(spark, sf_dir))


@query(f"{R} SELECT id, uri FROM r WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def records_by_ids(spark, sf_dir):
    return reads.by_ids(
        records(spark, sf_dir), table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    ).select("id", "uri")


@query(f"{R} SELECT id, md5(coalesce(ocr_text, '') || ' ' || coalesce(note, '') || ' ' || coalesce(app, '') || ' ') AS text_md5 FROM r")
def record_texts(spark, sf_dir):
    return reads.texts(records(spark, sf_dir), described=True).select("id", F.md5("text").alias("text_md5"))


@query(f"{R} SELECT id FROM r WHERE state = 0 AND taken_s >= 360000 ORDER BY taken_s DESC LIMIT 20")
def recent_topk(spark, sf_dir):
    return reads.pending(records(spark, sf_dir), 20, datetime(1970, 1, 5, 4)).select("id")


@query(f"{R} SELECT id FROM r WHERE state = 1 AND describe_version < 1 ORDER BY taken_s DESC LIMIT 20")
def describe_queue(spark, sf_dir):
    return reads.to_describe(records(spark, sf_dir), 20, 1).select("id")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumnsRenamed({"event_id": "id", "ts": "taken_at"})


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def date_range(spark, sf_dir):
    return reads.taken_between(_events(spark, sf_dir), datetime(2024, 1, 10), datetime(2024, 1, 12)).select("id")


@query("SELECT props AS query FROM events GROUP BY props ORDER BY max(ts) DESC, props LIMIT 8")
def recent_searches(spark, sf_dir):
    log = table(spark, sf_dir, "events").groupBy(F.col("props").alias("query")).agg(F.max("ts").alias("at"))
    return reads.recent_searches(log).select("query")


@query("SELECT source AS app, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def label_counts(spark, sf_dir):
    return reads.app_labels(records(spark, sf_dir))


@query("SELECT c AS category, count(*) AS n FROM (SELECT unnest([lang, source]) AS c FROM documents) WHERE c IS NOT NULL GROUP BY c")
def tag_counts(spark, sf_dir):
    return reads.category_order(records(spark, sf_dir)).filter("category is not null")


def _choices(df: DataFrame, label: str, package: str, position: str) -> DataFrame:
    return df.select(F.col(label).alias("label"), F.col(package).cast("string").alias("package"), F.col(position).cast("long").alias("position"))


@query("""WITH i AS (SELECT p_brand AS label, min(p_partkey) AS position FROM part GROUP BY p_brand), x AS (SELECT upper(p_brand) AS label, NULL AS package, 9 AS position, 2 AS part FROM part WHERE p_size = 1 UNION ALL SELECT n_name, 'nation', n_nationkey, 3 FROM nation),
a AS (SELECT i.label, i.position::VARCHAR AS package, i.position, 1 AS part FROM i UNION ALL SELECT * FROM x)
SELECT label, package FROM (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY part, position, label) AS k FROM a) WHERE k = 1""")
def app_choices(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    installed = part.groupBy(F.col("p_brand").alias("label")).agg(F.min("p_partkey").alias("position")).select(
        "label", F.col("position").cast("string").alias("package"), "position"
    )
    loud = part.filter("p_size = 1").select(
        F.upper("p_brand").alias("label"), F.lit(None).cast("string").alias("package"), F.lit(9).cast("long").alias("position")
    )
    return reads.app_choices(
        installed.select("label", "position"), installed,
        [loud, nation.select(F.col("n_name").alias("label"), F.lit("nation").alias("package"), F.col("n_nationkey").cast("long").alias("position"))]
    ).select("label", "package")


@query(
    "SELECT ts::DATE AS day, count(*) AS n, CASE WHEN ts::DATE = DATE '2024-01-28' THEN 'Today' WHEN ts::DATE = DATE '2024-01-27' THEN 'Yesterday' ELSE strftime(ts, '%a, %-d %b') END AS label FROM events GROUP BY ALL"
)
def day_groups(spark, sf_dir):
    return reads.by_day(_events(spark, sf_dir), date(2024, 1, 28))


@query(
    "SELECT ts::DATE AS day, event_id AS id, CASE WHEN ts::DATE = DATE '2024-01-28' THEN 'Today' WHEN ts::DATE = DATE '2024-01-27' THEN 'Yesterday' ELSE strftime(ts, '%a, %-d %b') END AS label FROM events"
)
def day_items(spark, sf_dir):
    return reads.by_day_items(_events(spark, sf_dir), date(2024, 1, 28))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT coalesce(sum(n) OVER (ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i, strftime(month, '%B %Y') AS label FROM m)
SELECT t.c_custkey AS target, (SELECT max_by(label, i) FROM k WHERE i <= t.c_custkey) AS label FROM customer t""")
def scrubber_marks(spark, sf_dir):
    marks = reads.month_marks(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("taken_at")))
    return reads.mark_at(marks, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target")))


@query("SELECT DISTINCT p_name AS label, p_brand AS package FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey < 5)")
def launchable(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return reads.launchable(
        part.select(F.col("p_name").alias("label"), F.col("p_brand").alias("package")),
        part.filter("p_partkey < 5").select(F.col("p_brand").alias("package"))
    )


@query(r"SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), reads.word_count(F.col("text")).cast("long").alias("words"))


@query("SELECT p_partkey AS id, p_name AS label FROM part WHERE contains(lower(p_name), 'a')")
def picker(spark, sf_dir):
    return reads.picker(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), " A")


@query(
    """SELECT user_id, list_reduce(list((value * 100)::BIGINT ORDER BY ts, (value * 100)::BIGINT), lambda a, x: (a * 9 + x) // 10) AS average FROM (SELECT user_id, ts, floor(value) AS value FROM events) GROUP BY user_id"""
)
def ewma_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", (F.floor("value") * 100).alias("v"))
    return reads.running_average(e, "user_id", "ts", "v")


@query(
    "SELECT 'added' AS change, doc_id AS id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT 'removed', doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT 'table', doc_id FROM labels WHERE quality = 0"
)
def sync_diff(spark, sf_dir):
    have = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    listing = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    after, added, removed = writes.sync(have, listing)
    say = lambda df, what: df.select(F.lit(what).alias("change"), "id")
    return say(added, "added").unionByName(say(removed, "removed")).unionByName(say(after, "table"))


@query(
    f"{R} SELECT id, attempts + (id % 5 = 0)::INT AS attempts, CASE WHEN id % 5 <> 0 THEN state WHEN attempts + 1 >= 3 THEN 2 ELSE 0 END AS state FROM r"
)
def retry_state(spark, sf_dir):
    r = records(spark, sf_dir)
    return writes.mark_failed(r, r.filter("id % 5 = 0")).select("id", "attempts", "state")


@query(f"{R} SELECT id, CASE WHEN ocr_pending THEN 0 ELSE state END AS state, CASE WHEN ocr_pending THEN 0 ELSE attempts END AS attempts FROM r")
def requeue_pending(spark, sf_dir):
    return writes.requeue(records(spark, sf_dir), only_ocr_pending=True).select("id", "state", "attempts")


@query(
    f"""{R} SELECT id, CASE WHEN id % 3 <> 0 THEN app WHEN app_source = 'user' THEN app WHEN id % 9 <> 0 THEN app ELSE 'new' END AS app, CASE WHEN id % 3 = 0 THEN upper(note) ELSE NULL END AS headline, CASE WHEN id % 3 = 0 THEN 1 ELSE state END AS state FROM r"""
)
def save_analysis(spark, sf_dir):
    r = records(spark, sf_dir)
    source = F.when(F.col("id") % 9 == 0, "usage").otherwise("text")
    new = r.filter("id % 3 = 0").select(
        "id", "ocr_text", F.lit("new").alias("app"), source.alias("app_source"), "app_package", "page_url", F.upper("note").alias("headline"),
        "categories", "entities"
    )
    return writes.save_analysis(r, new, 1).select("id", "app", "headline", "state")


@query(
    f"{R} SELECT id, CASE WHEN id % 4 = 0 AND id % 8 <> 0 THEN note END AS description, CASE WHEN id % 4 = 0 THEN 7 ELSE describe_version END AS describe_version FROM r"
)
def save_description(spark, sf_dir):
    r = records(spark, sf_dir)
    new = r.filter("id % 4 = 0").select(
        "id", F.when(F.col("id") % 8 == 0, "  ").otherwise(F.col("note")).alias("description"), F.array(F.lit("x")).alias("objects"),
        F.lit(None).cast("array<string>").alias("categories")
    )
    return writes.save_description(r, new, 7).select("id", "description", "describe_version")


@query(
    "SELECT query FROM (SELECT props AS query, max(ts) AS latest FROM (SELECT props, ts FROM events WHERE event_id % 2 = 0 UNION ALL SELECT trim('  ' || event_type || ' '), ts FROM events WHERE event_id % 2 = 1) GROUP BY 1) ORDER BY latest DESC, query LIMIT 20"
)
def recent_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.filter("event_id % 2 = 0").groupBy(F.col("props").alias("query")).agg(F.max("ts").alias("at"))
    return writes.add_recent(
        log, e.filter("event_id % 2 = 1").select(F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("query"), F.col("ts").alias("at"))
    ).select("query")


@query(
    "SELECT o_custkey AS collection_id, o_orderkey AS record_id FROM orders UNION SELECT o_custkey % 10, o_orderkey FROM orders WHERE o_orderkey % 7 = 0"
)
def add_to_collection(spark, sf_dir):
    items = _items(spark, sf_dir)
    more = items.filter("record_id % 7 = 0").withColumn("collection_id", F.col("collection_id") % 10)
    return writes.add_to_collection(items, more).select("collection_id", "record_id")


@query(
    f"{R} SELECT id, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 5 = 0 THEN 'seen' ELSE note END AS note, CASE WHEN id % 6 = 0 THEN NOT favorite ELSE favorite END AS favorite FROM r"
)
def edits(spark, sf_dir):
    r = records(spark, sf_dir)
    r = writes.set_note(r, r.filter("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, "").otherwise("seen").alias("note")))
    return writes.toggle_favorite(r, r.filter("id % 6 = 0")).select("id", "note", "favorite")


@query(
    f"{R} SELECT id, CASE WHEN id % 7 = 0 THEN upper(note) ELSE app END AS app, CASE WHEN id % 7 = 0 THEN 'p.' || note END AS app_package, CASE WHEN id % 7 = 0 THEN 'user' ELSE app_source END AS app_source FROM r"
)
def app_edits(spark, sf_dir):
    r = records(spark, sf_dir)
    return writes.set_app(r, r.filter("id % 7 = 0").select("id", F.upper("note").alias("app"), F.concat(F.lit("p."), "note").alias("app_package"))).select(
        "id", "app", "app_package", "app_source"
    )


@query(
    "SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'New name' ELSE c_name END AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 <> 0) AS n FROM customer"
)
def collection_edits(spark, sf_dir):
    items = _items(spark, sf_dir)
    left = writes.remove_from_collection(items, items.filter("record_id % 3 = 0"))
    return reads.collections(
        writes.rename_collection(_names(spark, sf_dir), 7, " New name "), left, _ordered(spark, sf_dir)
    ).select("id", "name", "n")


@query(
    f"SELECT '/media/' || CASE WHEN page_id % 3 = 0 THEN '{CAPTURE_FOLDER}/' ELSE 'Camera/' END || page_id AS path, CASE WHEN page_id % 2 = 0 THEN 0 ELSE page_id * 1000 END // 1000 + CASE WHEN page_id % 2 = 0 THEN page_id ELSE 0 END AS taken_s FROM pages WHERE page_id % 3 = 0"
)
def media_listing(spark, sf_dir):
    folder = F.when(F.col("page_id") % 3 == 0, f"{CAPTURE_FOLDER}/").otherwise("Camera/")
    media = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/media/"), folder, "page_id").alias("path"),
        F.when(F.col("page_id") % 2 == 0, 0).otherwise(F.col("page_id") * 1000).alias("taken_ms"), F.col("page_id").alias("added_s")
    )
    return store.captures(media).select("path", F.unix_seconds("taken_at").alias("taken_s"))


@query(
    "SELECT 'collections' AS part, count(*) AS n FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'items', count(*) FROM orders WHERE o_custkey <> 7 AND o_orderkey % 11 <> 0 UNION ALL SELECT 'records', count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 11 <> 0"
)
def deletions(spark, sf_dir):
    names, items = writes.delete_collection(_names(spark, sf_dir), _items(spark, sf_dir), 7)
    mine = _ordered(spark, sf_dir)
    left, items = writes.forget(mine, items, table(spark, sf_dir, "orders").filter("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("id")))
    count = lambda df, p: df.agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n")
    return count(names, "collections").unionByName(count(items, "items")).unionByName(count(left, "records"))


@query("SELECT doc_id AS id, doc_id * 3600 AS taken_s, lang AS category, 0 AS attempts FROM documents")
def upgrade(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") * 3600000).alias("taken_at"),
        F.concat(F.lit(",people,"), "lang", F.lit(",")).alias("categories"), F.lit("{broken").alias("entities")
    )
    return store.upgrade(old).select("id", F.unix_seconds("taken_at").alias("taken_s"), F.array_join("categories", ",").alias("category"), "attempts")


@query("SELECT event_id AS id, true AS same FROM events")
def entities_json(spark, sf_dir):
    e = F.array(
        F.struct(
            F.lit("DATE").alias("type"), F.col("event_type").alias("text"), F.col("props").alias("value"),
            F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("epoch_millis"), (F.col("event_id") % 3 == 0).alias("has_time")
        )
    )
    df = table(spark, sf_dir, "events").withColumn("e", e.cast(entities.TYPE))
    return df.select(F.col("event_id").alias("id"), (store.decode_entities(store.encode_entities(F.col("e"))) == F.col("e")).alias("same"))


def _named_sql(column: str) -> str:
    for name, text in sorted(HTML_NAMES.items(), key=lambda x: x[0] == "amp"):
        column = f"replace({column}, '&{name};', '{text.replace(chr(39), chr(39) * 2)}')"
    return column


@query(f"SELECT page_id AS id, md5({_named_sql('html')}) AS html_md5 FROM pages")
def html_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.md5(tx.unescape_named(F.col("html"))).alias("html_md5"))


@query("SELECT doc_id AS id, md5(trim(nfc_normalize(text), ' ' || chr(10) || chr(9) || chr(13))) AS text_md5 FROM documents")
def basic_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(tx.basic_clean_col("text")).alias("text_md5"))


@query()
def basic_clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.md5(tx.basic_clean_col("html")).alias("html_md5"))


@query(
    rf"SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{ENTITY_PATTERNS['EMAIL']}'), lambda x: lower(x)))), ',') AS emails FROM documents"
)
def entities_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(entities.emails(F.col("text")), ",").alias("emails"))


@query()
def entities_phone(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(entities.phones(F.col("text")), ",").alias("phones"))


@query()
def entities_all(spark, sf_dir):
    out = entities.with_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", TODAY)
    return out.select(F.col("doc_id").alias("id"), F.explode("entities").alias("e")).select("id", "e.type", "e.value", "e.epoch_millis")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _keyword_sql(text: str, keyword: str) -> str:
    if len(keyword) <= 4 and keyword.isalnum():
        edge = r"[^\p{L}\p{Nd}]"
        return rf"regexp_matches({text}, '(^|{edge}){re.escape(keyword)}({edge}|$)')"
    return f"contains({text}, {_quoted(keyword)})"


def _app_sql(app: str, name: str) -> str:
    return f"contains({app}, {_quoted(name)})" if len(name) >= 5 else f"list_contains(regexp_split_to_array({app}, '[ ._-]'), {_quoted(name)})"


def classify_sql() -> str:
    parts = []
    for k, (c, keywords) in enumerate(CATEGORY_KEYWORDS.items()):
        n = " + ".join(f"({_keyword_sql('t', w)})::INT" for w in keywords)
        own = " OR ".join(_app_sql("a", x) for x in CATEGORY_APPS[c]) or "false"
        parts.append(f"SELECT id, {k} AS k, '{c}' AS c, {n} AS n, ({own}) AS own FROM x")
    return f"""WITH x AS (SELECT doc_id AS id, lower(text) AS t, lower(source) AS a FROM documents), y AS ({" UNION ALL ".join(parts)}),
z AS (SELECT id, k, c, row_number() OVER (PARTITION BY id ORDER BY 6 * least(n, 4) + own::INT * 20 DESC, k) AS r FROM y WHERE own OR n >= 2)
SELECT x.id, coalesce(string_agg(z.c, ',' ORDER BY z.r), '') AS categories FROM x LEFT JOIN z ON x.id = z.id AND z.r <= 3 GROUP BY x.id"""


@query(classify_sql())
def classify_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.array_join(classify.classify(F.col("text"), F.col("source")), ",").alias("categories")
    )


#: What each app's interface says: its first two phrases, one app a page in turn.
_SAID = [" ".join(p.replace("+", " ") for p in list(phrases)[:2]) for phrases in APP_PHRASES.values()]


def hints_sql() -> str:
    parts = []
    for k, (app, phrases) in enumerate(APP_PHRASES.items()):
        score = " + ".join(
            f"{w} * ({' AND '.join(_keyword_sql('t', p if p.startswith(' ') else p.strip()) for p in ph.split('+'))})::INT"
            for ph, w in phrases.items()
        )
        parts.append(f"SELECT id, {k} AS k, {_quoted(app)} AS app, {score} AS s FROM x")
    said = f"[{', '.join(map(_quoted, _SAID))}][page_id % {len(_SAID)} + 1]"
    return f"""WITH x AS (SELECT page_id AS id, ' ' || replace(lower(html || chr(10) || {said}), chr(10), ' ') AS t FROM pages), y AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE s > 0)
SELECT id, string_agg(app || ':' || s, ',' ORDER BY s DESC, k) AS apps FROM y GROUP BY id"""


@query(hints_sql())
def app_hints(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("page_id") % len(_SAID) + 1).cast("int"))
    s = classify.app_scores(F.concat("html", F.lit("\n"), said))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["app"], x["score"])), ",").alias("apps")
    ).filter("apps <> ''")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' Tools' END AS label FROM nation")
def app_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    installed = n.filter("n_nationkey % 2 = 0").select(
        F.concat("n_name", F.lit(" Tools")).alias("label"), F.lit(None).cast("string").alias("package"),
        F.col("n_nationkey").cast("long").alias("position")
    )
    return classify.match_apps(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("answer")), installed).select("id", "label")


@query("SELECT doc_id AS id, 'App ' || (doc_id % 7) AS label FROM documents")
def file_names(spark, sf_dir):
    name = F.concat(F.lit("Capture_20240229_103000_App_"), F.col("doc_id") % 7, F.lit("_0123abcd.jpg"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), classify.app_of_file_name(name)["label"].alias("label"))


def _lines(spark, sf_dir):
    """The lines of each document as a screen's, the first one in larger letters."""
    # A column of its own: within the lambda the text would be split again for each line.
    docs = table(spark, sf_dir, "documents").withColumn("parts", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).withColumn(
        "n_parts", F.size("parts")
    )
    k = lambda x, i: F.struct(x.alias("text"), (i / F.col("n_parts")).cast("float").alias("top"), ((i + F.when(i == 0, 0.9).otherwise(0.3)) / F.col("n_parts")).cast("float").alias("bottom"), F.lit(0.0).cast("float").alias("left"))
    return docs.select(F.col("doc_id").alias("id"), F.col("text"), F.col("source"), F.transform("parts", k).alias("lines"))


#: The first line is three times as high as the others, so it alone is tall enough, if three lines can be used.
_HEADLINE = r"""WITH p AS (SELECT doc_id AS id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT id, lines, list_filter(lines, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 3 AND NOT regexp_matches(trim(x), '^[0-9]{1,2}[.:][0-9]{2}(\s?[ap]\.?m\.?)?$', 'i')) AS usable FROM p)
SELECT id, md5(CASE WHEN len(usable) >= 3 AND usable[1] = lines[1] THEN lines[1] ELSE '' END) AS headline_md5 FROM u"""


@query(_HEADLINE)
def headlines(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", F.md5(layout.headline(F.col("lines"))).alias("headline_md5"))


@query()
def reading_order(spark, sf_dir):
    """Every document is read, however long: one line of each text and place; a null text gives null."""
    return _lines(spark, sf_dir).select("id", F.md5(layout.reading_order(F.col("lines"))).alias("text_md5"))


@query("SELECT page_id AS id, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END AS link FROM pages")
def page_links(spark, sf_dir):
    line = F.array(F.struct(F.col("url").alias("text"), F.lit(0.05).cast("float").alias("top"), F.lit(0.08).cast("float").alias("bottom")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), layout.page_link(line, F.lit(True)).alias("link"))


@query(
    "SELECT s_suppkey AS id, CASE WHEN 3000 > 2.5 * (1000 + s_suppkey) THEN 1 + ceil((3000 - 2 * (1000 + s_suppkey)) / (2 * (1000 + s_suppkey) - (1000 + s_suppkey) // 10))::INT ELSE 1 END AS n FROM supplier"
)
def screen_slices(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.size(layout.slices(F.col("s_suppkey") + 1000, F.lit(3000))).alias("n")
    )


#: Role and text stand for the caption and the screen's own words, so only quotes without any word are untrue.
_DESCRIBED = r"""WITH s AS (SELECT conv_id, turn, role, list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
lambda x: trim(x) <> '' AND len(list_filter(regexp_extract_all(x, '["“”]([^"“”]{2,})["“”]', 1), lambda q: len(regexp_extract_all(q, '[\p{L}\p{N}]+')) = 0)) = 0) AS parts FROM conversations),
t AS (SELECT conv_id, turn, trim(CASE WHEN trim(array_to_string(parts, ' ')) = '' THEN trim(role) ELSE array_to_string(parts, ' ') END) AS t FROM s)
SELECT conv_id, turn, upper(t[1:1]) || t[2:] AS text FROM t"""


@query(_DESCRIBED)
def descriptions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn",
        captions.describe(
            F.col("role"), F.col("text"), F.concat(F.col("role"), F.lit("<loc_1><loc_2>"), F.col("role")), F.col("text")
        )["text"].alias("text")
    )


@query()
def enriched(spark, sf_dir):
    raw = _lines(spark, sf_dir).select(
        "id", F.concat(F.lit("Capture_20240229_103000_"), "source", F.lit(".jpg")).alias("name"), F.col("text").alias("ocr_text"), "lines"
    )
    return enrich.enrich(raw, TODAY).select(
        "id", "app", "app_source", F.size("entities").alias("n_entities"), F.array_join("categories", ",").alias("categories"), "state"
    )

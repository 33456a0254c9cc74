"""Registered queries whose inputs are made from the tables so that every branch of an operator is met, each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, entities, search
from ..shared import shared_dir
from ..sources import store
from .queries import _PAD, ORACLE_SQL, QUERIES, TODAY, dealt_out, rank_sql, search_records, snippet_sql, table
from .stored import index_of, query

#: Orders as messages: one entity of each kind, with the order's own numbers. Links end with a stop, amounts in two ways, dates in all forms.
_KINDS = (
    ("EMAIL", "'c' || k || '@Mail.example.com'", "lower('c' || k || '@Mail.example.com')"), ("UPI", "'pay' || k || '@okbank'", None),
    ("URL", "'www.shop' || k || '.example.net/o'", "'https://www.shop' || k || '.example.net/o'"), ("CODE", "'' || (100000 + k % 900000)", None),
    ("AMOUNT", "'Rs. ' || (1 + k % 9) || ',234.50'", "'₹' || (1 + k % 9) || '234.50'"), ("AMOUNT", "'$' || (k % 1000 + 7)", None),
    ("PHONE", "'+91 98765 ' || (10000 + k % 90000)", "'+9198765' || (10000 + k % 90000)"),
)
_DATES = (
    ("'2026-0' || (1 + k % 9) || '-1' || (k % 10)", "'2026-0' || (1 + k % 9) || '-1' || (k % 10)"),
    ("(10 + k % 10) || '/0' || (1 + k % 9) || '/2027'", "'2027-0' || (1 + k % 9) || '-' || (10 + k % 10)"),
    ("(10 + k % 10) || ' Oct 2028 at ' || (1 + k % 9) || ':30 pm'", "'2028-10-' || (10 + k % 10) || 'T' || (13 + k % 9) || ':30'"),
    ("'Nov ' || (10 + k % 10)", "'2026-11-' || (10 + k % 10)"), ("'Jan ' || (10 + k % 10)", "'2027-01-' || (10 + k % 10)"),
)
#: Between two entities: longer than the way on which a time counts for a date.
_MESSAGE = " || ' and then after quite a number of words ' || ".join(
    ["'Mail '", _KINDS[0][1], _KINDS[1][1], f"'see ' || {_KINDS[2][1]} || '.'", f"'Your OTP is ' || {_KINDS[3][1]}", *(x for x, _ in _DATES), *(x[1] for x in _KINDS[4:])]
)
_WANTED = " UNION ".join(
    [f"SELECT k AS id, '{kind}' AS type, {value or text} AS value FROM o" for kind, text, value in _KINDS] + [f"SELECT k, 'DATE', {value} FROM o" for _, value in _DATES]
)


@query(f"WITH o AS (SELECT o_orderkey AS k FROM orders) {_WANTED}")
def entities_planted(spark, sf_dir):
    """All kinds of entities at once, among them dates without a year (one of them next year's) and with a time."""
    keys = dealt_out(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k")
    docs = keys.select("k", F.expr(_MESSAGE).alias("text"))
    found = entities.with_entities(docs, "text", TODAY)
    # Outer: of a plain explode the optimiser makes a filter over the texts' entities, which looks for them a second time.
    return found.select(F.col("k").alias("id"), F.explode_outer("entities").alias("e")).filter("e is not null").select("id", "e.type", "e.value")


@query(f"SELECT id, 1 AS stage, tier, rank FROM ({rank_sql('ther than')})")
def cascade_words(spark, sf_dir):
    return search.cascade(search_records(spark, sf_dir), "ther than").select("id", "stage", "tier", "rank")


@query(
    rf"SELECT id, 2 AS stage, 'best' AS tier, (row_number() OVER (ORDER BY id DESC))::INT AS rank FROM (SELECT doc_id AS id FROM documents WHERE contains({_PAD.format("source || '  ' || text")}, ' ther ') AND contains({_PAD.format("source || '  ' || text")}, ' erint'))"
)
def cascade_beginnings(spark, sf_dir):
    """No record has the last word whole, some have words that begin with it."""
    return search.cascade(search_records(spark, sf_dir), "ther erint").select("id", "stage", "tier", "rank")


@query(
    f"""WITH r AS (SELECT doc_id AS id, text, CASE lang WHEN 'en' THEN ['movies'] WHEN 'fr' THEN ['food', 'movies'] ELSE ['news'] END AS c FROM documents),
w AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS rank FROM r WHERE list_contains(c, 'movies')) SELECT id, 'best' AS tier, rank::INT AS rank, 'CATEGORY' AS reason FROM w"""
)
def search_category(spark, sf_dir):
    """A query that asks for a category as a whole: its records, newest first; no text holds the words themselves."""
    own = F.when(F.array_contains("categories", "en"), F.array(F.lit("movies"))).when(
        F.array_contains("categories", "fr"), F.array(F.lit("food"), F.lit("movies"))
    ).otherwise(F.array(F.lit("news")))
    records = search_records(spark, sf_dir).withColumn("categories", own)
    return search.search(records, "my movies", TODAY).select("id", "tier", "rank", "reason")


@query(
    f"""WITH d AS (SELECT doc_id AS id, text || ' my movies list' AS text, lang = 'en' AS own FROM documents WHERE lang IN ('en', 'fr'))
SELECT id, 'best' AS tier, (row_number() OVER (ORDER BY own DESC, id DESC))::INT AS rank, CASE WHEN own THEN 'CATEGORY' ELSE 'TEXT' END AS reason, CASE WHEN NOT own THEN {snippet_sql("z.text", ["movies", "movy"])} END AS snippet FROM d z"""
)
def search_category_and_texts(spark, sf_dir):
    """Records of the category first, then those whose texts match, without the ones that are there already."""
    docs = search_records(spark, sf_dir).filter("array_contains(categories, 'en') or array_contains(categories, 'fr')")
    records = docs.withColumn("body", F.concat("body", F.lit(" my movies list"))).withColumn(
        "categories", F.when(F.array_contains("categories", "en"), F.array(F.lit("movies"))).otherwise(F.array().cast("array<string>"))
    )
    return search.search(records, "my movies", TODAY)


@query(
    """SELECT n_nationkey AS id, CASE n_nationkey % 6 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN n_name WHEN 3 THEN 'Lock screen' WHEN 4 THEN 'Home screen' END AS label FROM nation"""
)
def app_name_tiers(spark, sf_dir):
    """Every tier: the same name, without a leading word, one name a word longer, both screens, and no match."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 6
    answer = F.when(k == 0, F.upper("n_name")).when(k == 1, F.concat(F.lit("Google "), "n_name")).when(k == 2, F.concat("n_name", F.lit(" Store"))).when(
        k == 3, "the lock screen of a phone"
    ).when(k == 4, "HomeScreen").otherwise("zzz")
    installed = n.select(F.col("n_name").alias("label"), F.lit(None).cast("string").alias("package"), F.col("n_nationkey").cast("long").alias("position"))
    return classify.match_apps(n.select(F.col("n_nationkey").alias("id"), answer.alias("answer")), installed).select("id", "label")


@query(
    "SELECT 'x' || n_nationkey AS name, n_name AS meanings FROM nation UNION ALL SELECT 'kind' || n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation GROUP BY n_regionkey"
)
def synonym_groups(spark, sf_dir):
    """Nations as a file of synonym groups, read back: another name stands for its word, a kind for all words of its group."""
    word = F.struct(F.col("n_name").alias("word"), F.array(F.concat(F.lit("X"), "n_nationkey")).alias("also"))
    groups = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", word.alias("w")))), lambda x: x["w"]).alias("words")
    ).select(F.col("n_regionkey").cast("string").alias("id"), F.array(F.concat(F.lit("Kind"), "n_regionkey")).alias("kind"), "words")
    file = groups.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("id", "kind", "words"))).alias("groups"))).alias("value"))
    path = f"{shared_dir(spark)}/groups-{uuid.uuid4().hex}"
    file.write.text(path)
    return store.meanings(spark, path).select("name", F.array_join("meanings", ",").alias("meanings"))


@query(
    rf"SELECT page_id AS id, trim(regexp_replace(lower(url), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS key FROM pages"
)
def name_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), tx.name_key(F.col("url")).alias("key"))


@query(r"SELECT doc_id AS id, md5(regexp_replace(text, '[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*', ' ', 'g')) AS text_md5 FROM documents")
def flat_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(tx.flat(F.col("text"))).alias("text_md5"))


@query(ORACLE_SQL["match_tokens"])
def index_match(spark, sf_dir):
    return index_of(spark, sf_dir).match(tx.query_terms("ther than"))


assert set(ORACLE_SQL) <= set(QUERIES)

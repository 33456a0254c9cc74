"""The thin queries over the operators of this subpackage: inputs, production parameters and digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_lloyd, embedding_imi, language_crf, line_dedup, ngram_join, pii_bootstrap, quality_ftrl, secret_cnn, spelling_trie, substring_dedup, topk_search
from .byte_bpe import encode_decode
from .common import held_out, table
from .packing import pack


def digest(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    """Counts and the sha256 of the base spans, and all spans as text; spans: array of start, kind, end, base, in order."""
    joined = lambda only: F.expr(f"array_join(transform(filter({spans}, s -> {only}), s -> concat(s.kind, ':', s.start, ':', s.`end`)), ',')")
    counts = [F.expr(f"cast(size(filter({spans}, s -> s.base and s.kind = '{k}')) as long) as n_{k}") for k in kinds]
    return [*counts, F.sha2(joined("s.base"), 256).alias("base_sha256"), joined("true").alias("spans")]


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.extract(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", *digest("spans", pii_bootstrap.KINDS))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.scan(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", *digest("spans", ("assign", "access", "hex")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), "doc_id", "text", n=4, percent=85)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(
        table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_imi.dedup(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least=0.9)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_ftrl.fit(docs, labels, "doc_id", "text", "quality", ~held_out(F.col("doc_id")))
    out = quality_ftrl.score(docs, "doc_id", "text", model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"), "doc_id", "text", window=20, output=lambda kept: F.sha2(kept, 256))
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_crf.fit(docs, "doc_id", "text", "lang", ~held_out(F.col("doc_id")))
    return language_crf.identify(docs, "doc_id", "text", model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"), "doc_id", "text", size=40, rows=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_code_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_lloyd.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label"), parts=8, entries=16, rounds=6, scale=4096)


def op13_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_trie.variants(table(spark, sf_dir, "documents"), "doc_id", "text", size=6, least=5, times=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_pii, op3_secrets, op4_ngram_join, op5_byte_bpe, op6_embedding_dedup, op7_packing, op8_quality, op9_substring_dedup,
        op10_language_id, op11_line_dedup, op12_code_lloyd, op13_spelling_trie
    )
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rounds(n: int) -> str:
    """Lloyd rounds as steps of a WITH: assignments a0 .. an, codebooks b0 .. bn."""
    assign = """a{k} AS (SELECT x.id, x.label, x.p, arg_min(b.e, (list_sum(list_transform(list_zip(x.v, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT, b.e)) AS e,
min(list_sum(list_transform(list_zip(x.v, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT) AS d, any_value(x.v) AS v FROM x JOIN b{k} b ON x.p = b.p GROUP BY x.id, x.label, x.p)"""
    move = """s{k} AS (SELECT p, e, i, sum(z)::BIGINT AS z, count(*) AS n FROM (SELECT p, e, unnest(v) AS z, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list((z - ((z % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY p, e),
b{next} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)"""
    return ",\n".join([x for k in range(n) for x in (assign.format(k=k), move.format(k=k, next=k + 1))] + [assign.format(k=n)])


#: DuckDB SQL of those that SQL can express. The models, tokenizers, match offsets and packing have none: tests/llm compare
#: them with brute force, an exact round trip or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE {_SOUND}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op4_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op6_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.c) AS component_id, e.vec_id = min(r.c) AS kept FROM embeddings e JOIN r ON e.vec_id = r.vec_id GROUP BY e.vec_id""",
    "op9_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w), h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM s),
late AS (SELECT doc_id, i FROM h QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late), t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept, count(*) AS n FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op11_line_dedup": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT r, doc_id, list_transform(l, lambda x: {_SMALL.format("trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")}) AS k, l FROM d),
s AS (SELECT r, doc_id, unnest(list_distinct(list_filter(k, lambda x: length(x) >= 40))) AS key FROM k),
h AS (SELECT key, max(doc_id) AS last FROM s GROUP BY key HAVING count(*) >= 5),
g AS (SELECT s.r, list(key) AS lost FROM s JOIN h USING (key) WHERE s.doc_id IS DISTINCT FROM h.last GROUP BY s.r),
o AS (SELECT doc_id, l, list_filter(list_zip(l, k), lambda x: NOT list_contains(coalesce(lost, []), x[2])) AS stay FROM k LEFT JOIN g ON k.r = g.r)
SELECT doc_id, len(l) AS n_lines, len(l) - len(stay) AS n_dropped, sha256(coalesce(array_to_string(list_transform(stay, lambda x: x[1]), chr(10)), '')) AS kept_sha256 FROM o""",
    "op12_code_lloyd": f"""WITH w AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE {_SOUND}),
x AS (SELECT id, label, p, e[p * (len(e) // 8) + 1:(p + 1) * (len(e) // 8)] AS v FROM w, range(8) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, v AS c FROM x QUALIFY row_number() OVER (PARTITION BY p ORDER BY id) <= 16),
{_rounds(6)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6),
r AS (SELECT id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY id, label)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h""",
    # The checksum has no function: it is folded over the bytes of `<doc_id>:<run>`, which are those of ASCII or Latin-1 letters.
    "op13_spelling_trie": rf"""WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all({_SMALL.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS t FROM range(256) x(v)),
c AS (SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda z: CASE WHEN unicode(z) < 128 THEN [unicode(z)::BIGINT] ELSE [195::BIGINT, unicode(z)::BIGINT - 64] END)),
lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM u, t),
k AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM c GROUP BY 1),
w AS (SELECT word, n FROM k WHERE length(word) >= 6 AND n >= 5),
e AS (SELECT DISTINCT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM e a JOIN e b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
UNION SELECT e.word, w.word, w.n FROM e JOIN w ON e.cut = w.word UNION SELECT w.word, e.word, e.n FROM e JOIN w ON e.cut = w.word),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM p GROUP BY word),
o AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.form_n >= 5 * w.n THEN f.form END AS form, CASE WHEN f.form_n >= 5 * w.n THEN f.form_n END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
g AS (SELECT word, word AS root FROM o UNION SELECT g.word, o.form FROM g JOIN o ON g.root = o.word WHERE o.form IS NOT NULL)
SELECT o.word, o.form, g.root, o.n, o.n_near, o.form_n FROM o JOIN g ON o.word = g.word JOIN o z ON g.root = z.word AND z.form IS NULL""",
}

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions.dictionaries import APP_PHRASES, CATEGORY_KEYWORDS
from quillspark.operators import classify
from quillspark.operators.entities import settled
from quillspark.plans import reads
from quillspark.streaming import live

START = datetime(2026, 10, 3)


def batches_by_rule(seconds, quiet=3.0, longest=30.0):
    """(first, last, n) of arrivals in order: a batch ends `quiet` after its last arrival or `longest` after its first."""
    out, own = [], []
    for x in sorted(seconds):
        if own and x >= min(own[-1] + quiet, own[0] + longest):
            out.append((own[0], own[-1], len(own)))
            own = []
        own.append(x)
    return out + [(own[0], own[-1], len(own))]


def arrive(spark, folder, number, rows):
    df = spark.createDataFrame([(k, START + timedelta(seconds=s)) for k, s in rows], "folder string, at timestamp")
    df.coalesce(1).write.parquet(os.path.join(folder, f"{number:03d}"))


def test_arrivals_settle(spark, tmp_path):
    """A recorded stream, read in parts with a restart between them, ends batches as the rule says."""
    rng = random.Random(3)
    a = [0, 1, 2.5, 8, 9, 9, 20] + [25 + k * 2 for k in range(25)] + [90, 91]  # 50 s without a pause of 3 s: cut at 30 s
    b = [5.0, 5.1] + sorted(round(rng.uniform(10, 100), 2) for _ in range(40))
    rows = sorted([("a", x) for x in a] + [("b", x) for x in b], key=lambda r: r[1]) + [("end", 500.0)]
    inbox, done = tmp_path / "in", []
    cuts = [0, 3, 17, 40, len(rows) - 1, len(rows)]
    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        arrive(spark, str(inbox), k, rows[x:y])
        stream = spark.readStream.schema("folder string, at timestamp").parquet(f"{inbox}/*")
        q = live.settle(stream, "folder", "at", replay=True).writeStream.foreachBatch(
            lambda df, n: done.extend((r["key"], (r["first"] - START).total_seconds(), (r["last"] - START).total_seconds(), r["n"]) for r in df.collect())
        ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = [("a", *r) for r in batches_by_rule(a)] + [("b", *r) for r in batches_by_rule(b)]
    near = lambda rows: sorted((k, round(f, 2), round(z, 2), n) for k, f, z, n in rows)
    assert near(done) == near(want) and max(z - f for _, f, z, _ in done) > 20


def test_arrivals_settle_by_the_clock(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), 0, [("a", 0.0), ("a", 0.5), ("a", 100.0)])
    stream = spark.readStream.schema("folder string, at timestamp").parquet(f"{tmp_path}/in/*")
    done = []
    q = live.settle(stream, "folder", "at").writeStream.foreachBatch(
        lambda df, n: done.extend((r["first"], r["n"]) for r in df.collect())
    ).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            if len(done) == 2:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert sorted(done) == [(START, 2), (START + timedelta(seconds=100), 1)]


ROW = "id long, state int, categories array<string>, ocr_pending boolean, favorite boolean"


def test_counts_follow_changes(spark, tmp_path):
    """Counts kept from changes are those of the table after each change; a step touches the counts of its rows only."""
    rng = random.Random(5)
    some = lambda i: (i, rng.randrange(3), rng.sample(["food", "travel", "news", None], rng.randint(0, 3)), rng.random() < 0.5, rng.random() < 0.2)
    table, now, touched = {}, {}, []

    def publish(df, number):
        got = {(r["part"], r["name"]): r["n"] for r in df.collect()}
        touched.append(len(got))
        now.update(got)

    for step in range(4):
        before = [table.pop(i) for i in rng.sample(sorted(table), min(len(table), 3 * step))]
        after = [some(i) for i in ([r[0] for r in before[1:]] + list(range(100 * step, 100 * step + (20 if step < 3 else 0))))]
        table.update({r[0]: r for r in after})
        make = lambda rows: spark.createDataFrame(rows, ROW)
        live.retractions(make(before), make(after)).coalesce(1).write.parquet(str(tmp_path / "changes" / f"{step}"))
        stream = spark.readStream.schema("state int, categories array<string>, ocr_pending boolean, favorite boolean, sign long").parquet(f"{tmp_path}/changes/*")
        live.follow_counts(stream, publish, str(tmp_path / "state"), once=True).awaitTermination()
        whole = make(list(table.values()))
        want = {("category", r["category"]): r["n"] for r in reads.category_counts(whole).collect()}
        want |= {("state", k): v for k, v in reads.counts(whole).first().asDict().items()}
        assert {k: n for k, n in now.items() if n} == {k: n for k, n in want.items() if n}
    live.retractions(make([list(table.values())[0]]), make([])).coalesce(1).write.parquet(str(tmp_path / "changes" / "last"))
    live.follow_counts(stream, publish, str(tmp_path / "state"), once=True).awaitTermination()
    assert touched[-1] <= 2 + 3 + 2


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_as_of_lookup_by_ranges(spark, partitions):
    rng = random.Random(9)
    marks = [(rng.randrange(40) + 5, k, f"m{k}") for k in range(60)]
    targets = [(rng.randrange(60), k) for k in range(200)] + [(None, 900)] + [(7, 1000 + k) for k in range(50)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        m, t = spark.createDataFrame(marks, "at int, k int, label string"), spark.createDataFrame(targets, "at int, id int")
        out = reads.as_of(t, m, "at", "k", "label")
        got = {r["id"]: (r["at"], r["mark_at"], r["label"]) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    best = lambda at: max(((a, k, name) for a, k, name in marks if at is not None and a <= at), default=(None, None, None))
    assert got == {i: (at, best(at)[0], best(at)[2]) for at, i in targets}
    # The final plan and the first one: a task has a row for each range, never all marks.
    assert plan.count("SinglePartition") <= 2 and "Cartesian" not in plan
    empty = reads.as_of(t, m.limit(0), "at", "k", "label").collect()
    assert len(empty) == len(targets) and all(r["label"] is None for r in empty)


def test_claims_are_settled_in_order():
    rng = random.Random(1)
    spans = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(400) for _ in range(300))]
    claims, want = [], []
    for k, (a, z) in enumerate(spans):
        if all(z <= x or y <= a for x, y in claims):
            claims.append((a, z))
            want.append(k)
    assert settled(spans) == want
    many = [(k * 3, k * 3 + 2) for k in range(200_000)]
    assert len(settled(many + many)) == 200_000


def test_keywords_in_one_pass(spark):
    """The automaton against a test of each keyword, on texts made of keywords and their neighbours."""
    rng = random.Random(4)
    words = [w for ws in CATEGORY_KEYWORDS.values() for w in ws] + [p for ps in APP_PHRASES.values() for x in ps for p in x.split("+")] + ["x", "é", "9", "form", "ola"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", "\n", "-", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", "ott", "bott ott2 2ott ott"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.lower("t")
    one = F.array(*(classify.hits([classify.contains_keyword(low, w) for w in ws]) for ws in CATEGORY_KEYWORDS.values()))
    rows = df.select(classify.keyword_counts(low).alias("a"), one.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(sum(r["a"]) for r in rows) > 100
    assert df.limit(0).select(classify.keyword_counts(low)).count() == 0
    assert classify._category_words().found("") == set()

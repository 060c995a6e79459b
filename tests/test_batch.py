"""Batches of boolean queries as rows give what the queries give one by one."""

import random

from pyspark.sql import functions as F

from lexigrove.functions.analysis import LATIN
from lexigrove.operators.batch import holds, search_batch
from lexigrove.operators.boolean import search_many
from lexigrove.operators.index import build_index

WORDS = "a b c d e f the nowhere".split()


def small_index(spark, n=60):
    pick = random.Random(4)
    rows = [(i, " ".join(pick.choices("abcdefgh", k=pick.randint(0, 9))), i) for i in range(n)]
    rows.append((n, None, n))
    return build_index(spark.createDataFrame(rows, "id long, full_text string, doc_seq long").cache(), LATIN.with_lexicons(stopwords=["the"]))


def some_query(pick, depth=3):
    kind = pick.random()
    if depth == 0 or kind < 0.35:
        a, b = pick.choice(WORDS), pick.choice(WORDS)
        return pick.choice([a, a, f'"{a} {b}"', f"#{pick.randint(0, 4)}({a},{b})", f"{a}-{b}", '""', f'"{a}"', f"#1({a}"])
    left, right = some_query(pick, depth - 1), some_query(pick, depth - 1)
    return pick.choice([f"{left} AND {right}", f"{left} OR {right}", f"NOT {left}", f"({left})", f"({left} or {right}) and {left}", f"{left} {right}", f"{left}) AND {right}", f"AND {left}", f"({left}", ""])


def test_as_one_by_one(spark):
    pick, at = random.Random(6), small_index(spark)
    queries = {str(i): some_query(pick) for i in range(250)}
    frame = spark.createDataFrame([*queries.items(), ("blank", "  "), ("none", None)], "qid string, text string")
    got = sorted(map(tuple, search_batch(at, frame).collect()))
    assert got == sorted(map(tuple, search_many(at, queries).collect())) and len(got) == len(set(got)) > 500


def test_plan_does_not_grow(spark):
    pick, at = random.Random(7), small_index(spark)
    size = {}
    for n in (50, 10_000):
        frame = spark.range(n).select(F.col("id").cast("string").alias("qid"), F.element_at(F.array(*[F.lit(some_query(pick, 4)) for _ in range(40)]), (F.col("id") % 40 + 1).cast("int")).alias("text"))
        found = search_batch(at, frame)
        size[n] = found._jdf.queryExecution().optimizedPlan().toString().count("\n")
        assert found.count() > 0
    assert size[10_000] == size[50]


def test_no_queries(spark):
    empty = spark.createDataFrame([], "qid string, text string")
    assert search_batch(small_index(spark), empty).count() == 0
    assert search_batch(small_index(spark).__class__(spark.createDataFrame([], "doc_id long, doc_seq long"), spark.createDataFrame([], "term string, doc_id long, pos int"), LATIN), spark.createDataFrame([("1", "NOT a")], "qid string, text string")).count() == 0


def test_programs(spark):
    rows = [([0, 1, -1], [0, 1], True), ([0, 1, -1], [0], False), ([0, 1, 2, -1, -2], [1, 2], True), ([0, 1, 2, -1, -2], [1], False), ([0, -3, -3], [0], True), ([0, 1, -3, -1], [0], True), ([*range(40), *[-2] * 39], [17], True)]
    frame = spark.createDataFrame(rows, "program array<int>, has array<int>, wanted boolean")
    assert frame.where(holds(F.col("program"), F.col("has")) != F.col("wanted")).count() == 0


def test_postings_are_judged_once(spark):
    at = build_index(spark.createDataFrame([(1, "a b", 1), (2, "b c", 2), (3, "", 3)], "id long, full_text string, doc_seq long"), LATIN)
    found = search_batch(at, spark.createDataFrame([("x", "a"), ("y", "NOT b"), ("z", "NOT c AND b")], "qid string, text string"))
    assert sorted(map(tuple, found.collect())) == [("x", 1), ("y", 3), ("z", 1)]
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()

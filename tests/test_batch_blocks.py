"""A stored index's blocks judge a batch as the postings do, without rows of postings."""

import random

from pyspark.sql import functions as F

from lexigrove.functions.analysis import LATIN
from lexigrove.operators import batch, index, packed


def test_blocks_give_what_postings_give(spark, tmp_path):
    rng = random.Random(3)
    words = [chr(97 + i) * 2 for i in range(8)]
    texts = [(i, " ".join(rng.choices(words, [8, 8, 4, 4, 2, 2, 1, 1], k=rng.randint(0, 12)))) for i in range(300)]
    docs = spark.createDataFrame([*texts, (900, None), (901, "aa")], "doc_id long, text string").withColumn("doc_seq", F.col("doc_id"))
    packed.store(docs, LATIN, str(tmp_path / "index"), "doc_id", "text", block=32)
    stored, plain = packed.load(spark, str(tmp_path / "index"), LATIN), index.build_index(docs, LATIN, "doc_id", "text")
    leaf = lambda: rng.choice([lambda: rng.choice(words), lambda: f'"{" ".join(rng.choices(words, k=rng.randint(1, 3)))}"', lambda: f"#{rng.randint(0, 4)}({rng.choice(words)},{rng.choice(words)})", lambda: f"#2({words[0]}-{words[5]},{words[1]})", lambda: "absent", lambda: '""'])()
    queries = [(str(i), "".join(rng.choice(["", "NOT "]) + leaf() + rng.choice([" AND ", " OR "]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "NOT "]) + leaf()) for i in range(60)]
    asked = spark.createDataFrame([*queries, ("blank", " "), ("null", None)], "qid string, text string")
    of = lambda at: sorted(map(tuple, batch.search_batch(at, asked).collect()))
    found = of(stored)
    assert found == of(plain) and len(found) > 1000


def test_no_posting_is_made_a_row(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("aa bb cc").alias("text"), F.col("id").alias("doc_seq"))
    packed.store(docs, LATIN, str(tmp_path / "index"), "doc_id", "text")
    asked = spark.createDataFrame([("1", '#1(aa,bb) AND "bb cc"'), ("2", "#0(aa,aa)")], "qid string, text string")
    rows = batch.search_batch(packed.load(spark, str(tmp_path / "index"), LATIN), asked)
    plan = rows._jdf.queryExecution().toString()
    assert "Window" not in plan and "explode(positions" not in plan and "arrays_zip" not in plan
    assert rows.count() == 100

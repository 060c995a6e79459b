"""Every catalogued query against its DuckDB twin on the smallest tables, and the display and streaming parts."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexigrove.functions.analysis import LATIN
from lexigrove.operators import display
from lexigrove.operators.boolean import near, near_by_join
from lexigrove.operators.index import build_index
from lexigrove.plans import catalog, catalog_arabic, catalog_files
from lexigrove.streaming.ingest import append_postings

DATA = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES | catalog_arabic.QUERIES | catalog_files.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | catalog_arabic.ORACLE_SQL | catalog_files.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_entry_points(spark):
    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10


def test_ranked_rows(spark):
    run = spark.range(20).select(F.lit("q").alias("qid"), F.col("id").alias("doc_id"), (1 - F.col("id") / 20).alias("score"), (F.col("id") + 1).cast("int").alias("rank"))
    shown = display.ranked_rows(run, "cosine").orderBy("rank").collect()
    assert len(shown) == 16 and shown[0]["confidence"] == "🟢 Excellente" and shown[-1]["place"] == "..." and shown[-1]["doc_id"] == "+5"
    assert display.ranked_rows(run.where("rank <= 3"), "bm25").count() == 3


def test_proximity_plans_agree(spark):
    words = spark.range(60).select(F.col("id").alias("id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.element_at(F.array(*map(F.lit, "abcdefgh")), (F.xxhash64(F.col("id"), i) % 4 + 4).cast("int")))).alias("full_text"), F.col("id").alias("doc_seq"))
    postings = build_index(words, LATIN).postings.cache()
    for d in range(5):
        for left, right in ((["a"], ["b"]), (["c"], ["c"]), (["a", "d"], ["b", "d"])):
            assert {r[0] for r in near(postings, left, right, d).collect()} == {r[0] for r in near_by_join(postings, left, right, d).collect()}


def test_streamed_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "id long, full_text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    append_postings(stream, LATIN, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("term", "doc_id", "pos").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 0), ("a", 1, 2), ("b", 1, 1), ("b", 2, 0)]

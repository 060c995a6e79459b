"""The pipeline stage by stage, and the registered queries' SQL twins."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from lexigrove.llm import decontaminate, lines, queries, simhash, toxicity
from lexigrove.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "test")
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, DATA), name)
        if name == "toxicity":
            scored = toxicity.classify(before, labels).where("predicted = 0")
            assert ids(docs) == ids(scored)
        elif name == "line_dedup":
            assert ids(docs) == ids(before)
            kept = lines.duplicate_lines(before).where("kept").count()
            assert lines.duplicate_lines(docs).count() == kept and docs.where("n_chars <> length(text)").isEmpty()
        elif name == "near_dedup":
            assert ids(docs) == {r["component_id"] for r in simhash.near_duplicates(before).select("component_id").collect()} and docs.count() == len(ids(docs))
        elif name == "decontamination":
            assert ids(docs) == ids(before) - ids(decontaminate.contained(before, bench))
        if name != "encode":
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and ids(docs) == ids(before)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    plain = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else v.item() if hasattr(v, "item") else v
    rows = lambda f: sorted(repr([None if x is None else float(x) if isinstance(x, (int, float)) else x for x in map(plain, r)]) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []

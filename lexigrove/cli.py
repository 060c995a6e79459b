"""Command lines: `batch` runs query files over a corpus, `evaluate` scores a result file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexigrove.api import SearchEngine
from lexigrove.config import EngineConfig
from lexigrove.operators.evaluation import evaluate
from lexigrove.sources import text_files


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict | None:
    parser = argparse.ArgumentParser(prog="lexigrove")
    commands = parser.add_subparsers(dest="command", required=True)
    batch = commands.add_parser("batch")
    for name in ("corpus", "boolean", "ranked", "output"):
        batch.add_argument(f"--{name}", required=True)
    batch.add_argument("--stopwords")
    batch.add_argument("--protected")
    scores = commands.add_parser("evaluate")
    scores.add_argument("--qrels", required=True)
    scores.add_argument("--results", required=True)
    scores.add_argument("--k", type=int, default=10)
    said = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("lexigrove").getOrCreate()
    if said.command == "evaluate":
        row = evaluate(text_files.read_qrels(spark, said.qrels), text_files.read_results(spark, said.results), said.k).first().asDict()
        print(f"MAP: {row['map']:.4f}\nMRR: {row['mrr']:.4f}\nP@{said.k}: {row['p_at_k']:.4f}\nR@{said.k}: {row['r_at_k']:.4f}")
        return row
    engine = SearchEngine.from_config(spark, EngineConfig(corpus=said.corpus, stopwords=said.stopwords, protected_words=said.protected))
    engine.batch(text_files.read_queries(spark, said.boolean), text_files.read_queries(spark, said.ranked), said.output)
    return None


if __name__ == "__main__":
    main()

"""Retrieval effectiveness: MAP, MRR, precision and recall at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(qrels: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """(qid, n_rel, ap, rr, p_at_k, r_at_k) for each query with a relevant document; one without results has zeros.

    qrels (qid, doc_id, rel), results (qid, doc_id, rank). Repeated documents of a run count each time.
    """
    relevant = qrels.where("rel > 0").select("qid", "doc_id").distinct()
    wanted = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    marked = results.join(relevant.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left").select("qid", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.withColumn("hits", F.sum("hit").over(order))
    each = counted.groupBy("qid").agg(
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("gains"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("hit") == 1) & (F.col("rank") <= k), 1).otherwise(0)).alias("at_k"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wanted.join(each, "qid", "left").select(
        "qid", "n_rel",
        zero(F.col("gains") / F.col("n_rel")).alias("ap"),
        zero(1 / F.col("first")).alias("rr"),
        zero(F.col("at_k") / F.lit(k)).alias("p_at_k"),
        zero(F.col("at_k") / F.col("n_rel")).alias("r_at_k"),
    )


def evaluate(qrels: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """One row: map, mrr, p_at_k, r_at_k, means over the queries with a relevant document; zeros without any."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_query(qrels, results, k).agg(mean("ap").alias("map"), mean("rr").alias("mrr"), mean("p_at_k").alias("p_at_k"), mean("r_at_k").alias("r_at_k"))

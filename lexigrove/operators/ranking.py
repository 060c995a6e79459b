"""TF-IDF cosine and BM25 ranking of a batch of queries.

Only postings of query terms are joined; a document that shares no term with a query never meets it. Query terms are
broadcast where their count allows, and joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.analysis import Profile, analyze, stemmed
from lexigrove.operators.index import Index


def queries_frame(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(queries.items()), "qid string, text string")


def query_terms(queries: DataFrame, profile: Profile) -> DataFrame:
    """(qid, term, qtf): how often each term stands in each query."""
    rows = queries.select("qid", F.explode(analyze(F.col("text"), profile)).alias("token"))
    return stemmed(rows, "token", profile).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


#: Query terms up to this many rows are broadcast; more are joined by shuffle.
FEW_TERMS = 100_000
#: So many distinct terms become a filter.
FILTERED = 1000


def small(terms: DataFrame) -> DataFrame:
    """`terms`, marked for broadcast if it is counted to be small."""
    return F.broadcast(terms) if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS else terms


def asked(index: Index, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, doc_id, tf) and (term, df) of the terms of queries. A few terms become a filter on the scan of the postings, more
    are joined to it; no others are aggregated."""
    few = [r["term"] for r in terms.select("term").distinct().limit(FILTERED + 1).collect()]
    rows = index.only(few) if len(few) <= FILTERED else index.postings.join(terms.select("term"), "term", "left_semi")
    if index.stored:
        tf = index.tf.where(F.col("term").isin(few)) if len(few) <= FILTERED else index.tf.join(terms.select("term"), "term", "left_semi")
    else:
        tf = rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return tf, index.term_stats if index.stored else tf.groupBy("term").agg(F.count("*").alias("df"))


def log_tf(tf: Column) -> Column:
    return 1 + F.log10(tf)


def top(scores: DataFrame, k: int, key: Column | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the first k of each query by score, ties in document order."""
    order = Window.partitionBy("qid").orderBy(F.desc(key if key is not None else F.col("score")), "doc_seq")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")


def cosine_scores(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, doc_seq, raw, score): cosine clamped to [0, 1], and the same over the query's best; positive only."""
    terms = query_terms(queries, index.profile)
    few = terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    near = F.broadcast if few else lambda rows: rows
    terms = near(terms)
    tf, df = asked(index, terms)
    idf = F.log10(F.lit(float(index.n_docs)) / F.col("df"))
    weighted = df.join(terms, "term").select("qid", "term", "df", (log_tf(F.col("qtf")) * idf).alias("wq"))
    lengths = weighted.groupBy("qid").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qnorm"))
    dots = tf.join(weighted, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * log_tf(F.col("tf")) * idf).alias("dot"))
    raw = F.col("dot") / (F.when(F.col("qnorm") == 0, 1.0).otherwise(F.col("qnorm")) * F.col("norm"))
    rows = dots.join(near(lengths), "qid").join(index.norms, "doc_id").withColumn("raw", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    rows = rows.where("raw > 0").join(index.documents, "doc_id")
    # A query's best is a maximum that tasks find of their own rows first: a row for each query, no more than terms are, beside its results.
    best = rows.groupBy("qid").agg(F.max("raw").alias("best"))
    return rows.join(near(best), "qid").select("qid", "doc_id", "doc_seq", "raw", (F.col("raw") / F.col("best")).alias("score"))


def bm25_scores(index: Index, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, doc_id, doc_seq, score): a term counts as often as the query repeats it; positive scores only."""
    terms = small(query_terms(queries, index.profile))
    tf, df = asked(index, terms)
    n, avgdl = float(index.n_docs), index.avgdl or 1.0
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    rows = tf.join(df, "term").join(terms, "term").join(index.doc_stats, "doc_id")
    return rows.groupBy("qid", "doc_id", "doc_seq").agg(F.sum(F.col("qtf") * idf * gain).alias("score")).where("score > 0")


def rank_cosine(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    return top(cosine_scores(index, queries), k)


def rank_bm25(index: Index, queries: DataFrame, k: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    return top(bm25_scores(index, queries, k1, b), k)

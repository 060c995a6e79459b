"""What a result list shows beside its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.analysis import analyze_texts
from lexigrove.operators.index import Index

SHOWN = 15


def cosine_label(score: Column) -> Column:
    return F.when(score > 0.8, "🟢 Excellente").when(score > 0.5, "🟡 Bonne").when(score > 0.2, "🟠 Faible").otherwise("🔴 Très faible")


def bm25_label(rank: Column) -> Column:
    return F.when(rank <= 3, "🟢 Top 3").when(rank <= 10, "🟡 Top 10").otherwise("⚪ Classé")


def ranked_rows(results: DataFrame, algorithm: str = "cosine") -> DataFrame:
    """(rank, doc_id, score, confidence, details) as text, the first 15, and a row `...` that says how many more; no results
    give one row that says so."""
    label = cosine_label(F.col("score")) if algorithm == "cosine" else bm25_label(F.col("rank"))
    shown = F.format_string("%.4f", "score")
    rows = results.where(F.col("rank") <= SHOWN).select("rank", F.col("rank").cast("string").alias("place"), F.col("doc_id").cast("string").alias("doc_id"), shown.alias("score"), label.alias("confidence"), F.concat(F.lit("Score: "), shown).alias("details"))
    more = results.agg((F.count("*") - SHOWN).alias("n")).where("n > 0").select(F.lit(SHOWN + 1).alias("rank"), F.lit("...").alias("place"), F.concat(F.lit("+"), F.col("n").cast("string")), F.lit(""), F.lit(""), F.lit(""))
    none = results.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("rank"), F.lit("1").alias("place"), F.lit("Aucun").alias("doc_id"), F.lit("0.0000").alias("score"), F.lit("-").alias("confidence"), F.lit("Aucun résultat").alias("details"))
    return rows.union(more).union(none)


def boolean_rows(index: Index, results: DataFrame, query: str) -> DataFrame:
    """(doc_id, found, occurrences, terms): how many of the query's terms, repeats counted each time, the document has,
    how often in all, and the first three of the query's terms."""
    spark = results.sparkSession
    terms = analyze_texts(spark, [query], index.profile)[0]
    times = {t: terms.count(t) for t in terms}
    each = index.only(sorted(times)).join(results.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    weight = F.lit(0)
    for term, n in times.items():
        weight = F.when(F.col("term") == term, n).otherwise(weight)
    sums = each.withColumn("w", weight).groupBy("doc_id").agg(F.sum("w").alias("found"), F.sum(F.col("w") * F.col("n")).alias("occurrences"))
    text = ", ".join(terms[:3]) + (f"... (+{len(terms) - 3})" if len(terms) > 3 else "")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    shown = F.when(zero("found") > 0, F.lit(text)).otherwise(F.lit("0 terme(s) trouvé(s)"))
    return results.select("doc_id").join(sums, "doc_id", "left").select("doc_id", zero("found").alias("found"), zero("occurrences").alias("occurrences"), shown.alias("terms"))


def summary(results: DataFrame) -> DataFrame:
    """(qid, n, best, mean) of ranked results."""
    return results.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.avg("score").alias("mean"))

"""Lexicons, query files, judgements and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexigrove.functions.analysis import normalize, strip_article


SEQ = "struct<file:string,start:long,at:long>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, seq): lines with their place: file by path, the byte at which the reader's range starts, and the number in it. Spark
    reads a range from its start, but larger files before smaller ones, so the number alone doesn't order lines of several files."""
    m = F.col("_metadata")
    seq = F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(F.col("value").alias("line"), seq.alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, place): lines with their places, from 0, in the order of seq. The ranges' lines are counted, and what the ranges before it
    hold is added to a line's number in its own, so no line is exchanged. It raises if the file is cut otherwise when it is read again."""
    rows = lines(spark, path).select("line", F.col("seq.file").alias("file"), F.col("seq.start").alias("start"), F.col("seq.at").alias("at"))
    ranges = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    found = rows.join(F.broadcast(ranges.select("file", "start", "first", before.alias("before"))), ["file", "start"], "left")
    same = F.shiftright("at", 33) == F.shiftright("first", 33)
    return found.select("line", F.when(same, F.col("before") + F.col("at") - F.col("first")).otherwise(F.raise_error(F.lit("the file was cut into other ranges")).cast("long")).alias("place"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """lines(), stripped."""
    return lines(spark, path).select(F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("line"), "seq")


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, seq): lines `qid text`, parted at the first blank; blank lines, # comments and lines without a blank are
    skipped; the last of a repeated qid counts. A missing file has no queries."""
    try:
        rows = _lines(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], f"qid string, text string, seq {SEQ}")
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains(" "))
    parts = F.split("line", " ", 2)
    return _last(rows.select(parts[0].alias("qid"), parts[1].alias("text"), "seq"), "qid")


def read_stopwords(spark: SparkSession, path: str, normalized: bool = False) -> frozenset[str]:
    """The stopwords, their article stripped; not normalised unless asked for. A missing file raises. A lexicon is a short
    list, so it comes to the driver and travels as a literal."""
    rows = _lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    word = strip_article(F.col("line"))
    return frozenset(r[0] for r in rows.select(normalize(word) if normalized else word).distinct().collect())


def read_protected_words(spark: SparkSession, path: str) -> frozenset[str]:
    """The protected words, stripped and then normalised. A missing file gives none."""
    try:
        rows = _lines(spark, path)
    except AnalysisException:
        return frozenset()
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return frozenset(r[0] for r in rows.select(normalize(strip_article(F.col("line")))).distinct().collect() if r[0])


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel): white-space separated `qid iteration doc rel`, further fields ignored; short lines and lines whose
    rel is no integer are dropped; the last of a repeated pair counts. A missing file has no judgements."""
    parts = F.split("line", r"(?U)\s+")
    try:
        lines = _lines(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], "qid string, doc_id string, rel int")
    rows = lines.where(F.size(parts) >= 4).select(parts[0].alias("qid"), parts[2].alias("doc_id"), F.expr("try_cast(split(line, '\\\\s+')[3] AS INT)").alias("rel"), "seq")
    return _last(rows.where("rel is not null"), "qid", "doc_id").drop("seq")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, score, rank): `qid,doc[,score]`, score 1.0 where missing; ranked by score, ties in file order. A missing
    file has no results."""
    parts = F.split("line", ",")
    try:
        lines = _lines(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], "qid string, doc_id string, score double, rank int")
    rows = lines.where(F.size(parts) >= 2).select(F.trim(parts[0]).alias("qid"), F.trim(parts[1]).alias("doc_id"), F.when(F.size(parts) >= 3, F.expr("try_cast(trim(split(line, ',')[2]) AS DOUBLE)")).otherwise(F.lit(1.0)).alias("score"), "seq")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seq")
    return rows.where("score is not null").select("qid", "doc_id", "score", F.row_number().over(order).alias("rank"))

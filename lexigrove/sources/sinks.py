"""Sinks: index dumps, boolean and ranked result files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexigrove.sources.workspace import shuffles_deleted


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """One file at `path` of the part files of `folder`, in the order of their names. The store's file system moves the bytes: by
    concat, where it can, else as one stream from part to part, each of which is deleted once it is copied. Nothing is collected, and
    no task writes the whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    source = jvm.org.apache.hadoop.fs.Path(folder)
    store = source.getFileSystem(conf)
    parts = sorted((x.getPath() for x in store.listStatus(source) if x.isFile() and not x.getPath().getName().startswith(("_", "."))), key=lambda x: x.getName())
    if store.getScheme() == "hdfs" and len(parts) > 1:
        array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
        for i, part in enumerate(parts[1:]):
            array[i] = part
        store.concat(parts[0], array)
        store.rename(parts[0], tmp)
    else:
        out = store.create(tmp)
        for part in parts:
            piece = store.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, conf, False)
            piece.close()
            store.delete(part, False)
        out.close()
    store.delete(to, True)
    store.rename(tmp, to)


def save_lines(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """The one column of `lines`, in order: a folder of text files whose names are in order, or one file."""
    spark, parts = lines.sparkSession, f"{path}.{uuid.uuid4().hex}.parts"
    with shuffles_deleted(spark):
        lines.write.mode("overwrite").text(parts if one_file else path)
    if not one_file:
        return
    join_parts(spark, parts, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(parts)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def index_lines(postings: DataFrame, lists: DataFrame | None = None, term_stats: DataFrame | None = None) -> DataFrame:
    """(term, number, id, line): for each term `term:df` and below it a tab-led `doc: p1,p2` per document. An index that knows them
    gives `lists` (term, doc_id, p) and `term_stats` (term, df)."""
    each = postings.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("p")) if lists is None else lists
    line = F.concat(F.lit("\t"), F.col("doc_id").cast("string"), F.lit(": "), F.array_join(F.transform("p", lambda x: x.cast("string")), ","))
    # An integer's text wouldn't order it further, but would be exchanged.
    id_ = F.when(F.col("doc_id").isNotNull(), "-") if isinstance(each.schema["doc_id"].dataType, IntegralType) else F.col("doc_id").cast("string")
    docs = each.select("term", F.struct(F.expr("coalesce(try_cast(doc_id AS BIGINT), 9223372036854775807)").alias("number"), id_.alias("id"), line.alias("line")).alias("x"))
    counts = each.groupBy("term").agg(F.count("*").alias("df")) if term_stats is None else term_stats
    terms = counts.select("term", F.struct(F.lit(-1 << 63).cast("long").alias("number"), F.lit("").alias("id"), F.concat("term", F.lit(":"), F.col("df").cast("string")).alias("line")).alias("x"))
    return docs.union(terms).select("term", "x.number", "x.id", "x.line")


def save_index(postings: DataFrame, path: str, one_file: bool = False, lists: DataFrame | None = None, term_stats: DataFrame | None = None) -> None:
    """The dump in order, as text files or one; terms sort by code point, documents by number."""
    save_lines(index_lines(postings, lists, term_stats).orderBy("term", "number", "id").select("line"), path, one_file)


def save_postings(postings: DataFrame, path: str) -> None:
    """Postings as Parquet, range-partitioned and sorted by term, so that a term's lookup reads few row groups."""
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(path)


def save_boolean_results(results: DataFrame, path: str, one_file: bool = False) -> None:
    """`qid,doc`, by number; ids that are no numbers come last."""
    keys = [F.expr("try_cast(qid AS BIGINT)").asc_nulls_last(), F.col("qid"), F.expr("try_cast(doc_id AS BIGINT)").asc_nulls_last(), F.col("doc_id")]
    save_lines(results.orderBy(*keys).select(F.concat_ws(",", F.col("qid").cast("string"), F.col("doc_id").cast("string"))), path, one_file)


def save_ranked_results(results: DataFrame, path: str, one_file: bool = False) -> None:
    """`qid,doc,score` with four decimals, by query number and rank."""
    keys = [F.expr("try_cast(qid AS BIGINT)").asc_nulls_last(), F.col("qid"), F.col("rank")]
    save_lines(results.orderBy(*keys).select(F.concat_ws(",", F.col("qid").cast("string"), F.col("doc_id").cast("string"), F.format_string("%.4f", "score"))), path, one_file)

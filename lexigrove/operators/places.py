"""Numbering rows in an order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.sources import workspace


def numbered(rows: DataFrame, *order: Column | str, column: str = "place") -> DataFrame:
    """`rows` with their place, from 0, in `order`.

    They are sorted by range partitions and written; a partition's rows are counted, and what the partitions before it hold is
    added to a row's number in its own. Only the counts, a row for each partition, meet in one task.
    """
    spark, path = rows.sparkSession, workspace.fresh(rows.sparkSession, "numbered")
    low = (1 << 33) - 1
    at = F.monotonically_increasing_id()
    rows.orderBy(*order).withColumn("__at", at).write.parquet(path)
    kept = spark.read.parquet(path)
    sizes = kept.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("n"))
    parts = sizes.agg(F.sort_array(F.collect_list(F.struct("__part", "n"))).alias("p"))
    before = F.aggregate(F.slice("p", 1, F.col("i")), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    offsets = parts.select("p", F.posexplode("p").alias("i", "x")).select(F.col("x.__part").alias("__of"), before.alias("__before"))
    return kept.join(F.broadcast(offsets), F.shiftright("__at", 33) == F.col("__of")).withColumn(column, F.col("__before") + F.col("__at").bitwiseAND(F.lit(low))).drop("__at", "__of", "__before")


def stored_order(rows: DataFrame, column: str = "place") -> DataFrame:
    """`rows` with the place that each has in the order in which they come."""
    path = workspace.fresh(rows.sparkSession, "ordered")
    rows.write.parquet(path)
    m = F.col("_metadata")
    kept = rows.sparkSession.read.parquet(path).select("*", F.struct(m["file_name"], m["row_index"]).alias("__seq"))
    return numbered(kept, "__seq", column=column).drop("__seq")

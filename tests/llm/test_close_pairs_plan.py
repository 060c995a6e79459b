"""Rows multiplied by the choices of blocks are exchanged, however small the table of fingerprints is on disk."""

from lexigrove.llm import simhash


def test_multiplied_rows_are_not_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("xxhash64(id) AS fp").write.parquet(str(tmp_path / "fps"))
    pairs = simhash.close_pairs(spark.read.parquet(str(tmp_path / "fps")), 4, 7)
    pairs.count()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan

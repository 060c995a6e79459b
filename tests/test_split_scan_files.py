"""The files that Spark's XML reader is given grow in number, not in size."""

from lexigrove.plans import catalog_files


def test_files_follow_the_exchange(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("9", "false"), strict=True):
            spark.conf.set(name, value)
        rows = catalog_files.articles_split_scan(spark, "/root/testdata/sf0.001")
        assert len(rows.inputFiles()) == 9
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)

"""Lines of files are numbered without exchanging them; a joined file's parts and its sort's shuffle files are gone."""

from pyspark.sql import functions as F

from lexigrove.sources import sinks, text_files


def test_lines_of_many_ranges_and_files(spark, tmp_path):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "a.txt").write_text("short\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(20_000)))
    (tmp_path / "c.txt").write_text("".join(f"c{i}\n" for i in range(3_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = text_files.numbered_lines(spark, str(tmp_path))
        assert "hashpartitioning(line" not in rows._jdf.queryExecution().toString() and "rangepartitioning(seq" not in rows._jdf.queryExecution().toString()
        got = {r["place"]: r["line"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = ["short", *[f"b{i}" for i in range(20_000)], *[f"c{i}" for i in range(3_000)]]
    assert got == dict(enumerate(want))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.txt").write_text("")
    assert text_files.numbered_lines(spark, str(tmp_path / "none")).count() == 0


def test_integers_are_ordered_without_their_text(spark):
    postings = spark.createDataFrame([("a", 10, 0), ("a", 9, 1), ("a", 9, 0), ("a", -(1 << 63), 0), ("b", None, 0)], "term string, doc_id long, pos int")
    rows = sinks.index_lines(postings)
    assert {r["id"] for r in rows.collect()} == {"", "-", None}
    lines = [r["line"] for r in rows.orderBy("term", "number", "id").collect()]
    assert lines == ["a:3", f"\t{-(1 << 63)}: 0", "\t9: 0,1", "\t10: 0", "b:1", None]
    texts = sinks.index_lines(postings.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert [r["line"] for r in texts.orderBy("term", "number", "id").collect()] == lines


def test_joined_parts_are_deleted_one_by_one(spark, tmp_path):
    spark.range(40).repartition(4).select(F.col("id").cast("string")).write.text(str(tmp_path / "parts"))
    sinks.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "all.txt"))
    assert not [p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-")]
    assert sorted(map(int, (tmp_path / "all.txt").read_text().split())) == list(range(40))

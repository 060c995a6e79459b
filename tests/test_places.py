"""Numbered rows, stored order, files in order and files joined from parts."""

from pyspark.sql import functions as F

from lexigrove.operators import places
from lexigrove.sources import sinks, text_files


def test_numbered(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(7)
    got = places.numbered(rows, F.desc("v")).collect()
    assert sorted((r["place"], r["v"]) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert places.numbered(rows.where("false"), "v").count() == 0
    tied = places.numbered(rows.select((F.col("v") % 3).alias("v")), "v").collect()
    assert sorted(r["place"] for r in tied) == list(range(1000))


def test_stored_order(spark):
    got = places.stored_order(spark.range(300).orderBy(F.desc("id"))).collect()
    assert {r["id"]: r["place"] for r in got} == {i: 299 - i for i in range(300)}


def test_one_file_of_many_parts(spark, tmp_path):
    lines = spark.range(500).repartition(9).orderBy("id").select(F.concat(F.lit("سطر "), F.col("id").cast("string")).alias("line"))
    for _ in range(2):  # an older file gives way
        sinks.save_lines(lines, str(tmp_path / "all.txt"), one_file=True)
    assert (tmp_path / "all.txt").read_text(encoding="utf-8") == "".join(f"سطر {i}\n" for i in range(500))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.txt"]
    sinks.save_lines(lines.where("false"), str(tmp_path / "none.txt"), one_file=True)
    assert (tmp_path / "none.txt").read_text() == ""


def test_files_are_read_by_path_whatever_their_size(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 first\n2 stays\n")
    (tmp_path / "b.txt").write_text("# longer\n" + "3 other words\n" * 50 + "1 last\n")
    assert {r["qid"]: r["text"] for r in text_files.read_queries(spark, str(tmp_path)).collect()} == {"1": "last", "2": "stays", "3": "other words"}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("q,late,0.5\n" * 40)
    (tmp_path / "c" / "b.csv").write_text("q,first,0.9\nq,tied,0.5\n")
    ranked = [(r["rank"], r["doc_id"]) for r in text_files.read_results(spark, str(tmp_path / "c")).orderBy("rank").collect()]
    assert ranked[0] == (1, "first") and ranked[-1] == (42, "tied")

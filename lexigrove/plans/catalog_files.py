"""Scans and sinks over the shared tables: each query writes what a reader reads back, with DuckDB twins.

Files go to a fresh folder of the session's workspace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove import cli
from lexigrove.api import SearchEngine
from lexigrove.functions.analysis import LATIN
from lexigrove.operators import boolean, display, places
from lexigrove.plans import catalog
from lexigrove.sources import articles, sinks, text_files, workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written(lines: DataFrame, name: str) -> str:
    """The path of a text file of the one column of `lines`."""
    path = workspace.fresh(lines.sparkSession, name)
    lines.write.text(path)
    return path


#: Characters that no XML file can hold.
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"


def _whole(c: str) -> Column:
    """A text without what XML cannot hold or doesn't keep."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), NO_XML, ""), "\r\n?", "\n")


def _line(c: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\s\x0B]+", " "))


def _digest(c: str) -> Column:
    return F.md5(F.col(c).cast("binary")).alias(c)


def _digests(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("doc_id"), "headline", _digest("text"), _digest("full_text"))


def _escaped(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("é", "&#233;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def _articles(docs: DataFrame, root: str) -> DataFrame:
    """(line) in order: a file of articles, each a line of many; escaped or in CDATA sections, some deeper, with comments and
    instructions around them that hold end tags, or children after the text."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}> "), value, F.lit(f"\n</{name}>"))
    of = lambda n, k: F.pmod("doc_id", F.lit(n)) == k
    text = _whole("text")
    section = F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
    shown = F.when(of(5, 2) & F.lit(bool(root)) & ~text.contains("</Article>"), section).otherwise(_escaped(text))
    body = F.concat(F.lit("<Article>"), tag("ID", F.col("doc_id").cast("string")), F.when(F.col("lang").isNotNull(), tag("HEADLINE", F.concat(_escaped(_whole("lang")), F.lit("<b>x</b> tail")))).otherwise(F.lit("")), tag("TEXT", F.concat(shown, F.when(of(4, 1), F.lit("<i/>after")).otherwise(F.lit("")))), F.lit("<TEXT>later</TEXT></Article>"))
    deeper = F.when(of(7, 3), F.concat(F.lit("<Section n='a>b'><Part>"), body, F.lit("</Part></Section>"))).when(of(7, 4), F.concat(F.lit("<!-- <Article><ID>0</ID><TEXT>no</TEXT></Article> -->"), body, F.lit("<?skip </Article> ?>"))).otherwise(body)
    rows = docs.select(F.lit(1).alias("part"), "doc_id", deeper.alias("line"))
    ends = [docs.sparkSession.range(1).select(F.lit(part).alias("part"), F.col("id").alias("doc_id"), F.lit(line).alias("line")) for part, line in ((0, f"<?xml version='1.0' encoding='UTF-8'?>\n<{root}>"), (2, f"</{root}>"))]
    return (rows.union(ends[0]).union(ends[1]) if root else rows).orderBy("part", "doc_id").select("line")


def articles_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file, parsed strictly in ranges of a megabyte."""
    path = workspace.fresh(spark, "articles") + ".xml"
    sinks.save_lines(_articles(_table(spark, sf_dir, "documents").where("doc_id is not null"), "Corpus"), path, one_file=True)
    return _digests(articles.read_articles(spark, path, split_bytes=1 << 20))


def articles_rootless_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a root, which are parsed again inside one of their own."""
    path = workspace.fresh(spark, "articles")
    sinks.save_lines(_articles(_table(spark, sf_dir, "documents").where("doc_id is not null"), ""), path)
    return _digests(articles.read_articles(spark, path, split_bytes=1 << 20))


def articles_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a file's articles by doc_seq."""
    path = workspace.fresh(spark, "articles") + ".xml"
    sinks.save_lines(_articles(_table(spark, sf_dir, "documents").where("doc_id is not null"), "Corpus"), path, one_file=True)
    rows = articles.read_articles(spark, path, split_bytes=1 << 20).select(F.col("id").cast("long").alias("doc_id"), "doc_seq")
    return places.numbered(rows, "doc_seq").select("doc_id", "place")


def articles_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a root, read by Spark's XML reader."""
    path = workspace.fresh(spark, "articles")
    rows = _table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("ID"), F.col("lang").alias("HEADLINE"), _whole("text").alias("TEXT"))
    rows.repartition("ID").write.format("xml").option("rootTag", "Corpus").option("rowTag", "Article").save(path)
    return _digests(articles.read_articles(spark, path, strict=False))


def query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark")
    lines = F.concat(F.lit("  "), F.col("item_id").cast("string"), F.lit(" "), _line("text"))
    some = rows.select(F.explode(F.array(lines, F.lit("# comment line"), F.lit(""), F.lit("alone"))))
    return text_files.read_queries(spark, _written(some, "queries")).select(F.col("qid").cast("long").alias("qid"), "text")


def query_files_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files, the later one smaller: the last line of a repeated query is the later file's."""
    rows, folder = _table(spark, sf_dir, "benchmark").where("item_id is not null"), workspace.fresh(spark, "queries")
    line = lambda word: F.concat(F.col("item_id").cast("string"), F.lit(f" {word} "), _line("text"))
    sinks.save_lines(rows.select(line("old")), f"{folder}/a.txt", one_file=True)
    sinks.save_lines(rows.where("item_id % 2 = 1").select(line("new")), f"{folder}/b.txt", one_file=True)
    return text_files.read_queries(spark, folder).select(F.col("qid").cast("long").alias("qid"), "text")


def stopword_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit("ال"), "n_name"), F.concat(F.lit("لا"), "n_name"), F.concat(F.lit("# "), "n_name"), F.lit(" "))))
    return spark.createDataFrame([(w,) for w in sorted(text_files.read_stopwords(spark, _written(words, "stopwords")))], "word string")


def protected_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit("أل"), "n_name"), F.concat(F.lit(" إـى"), "n_name"), F.concat(F.lit("# "), "n_name"))))
    return spark.createDataFrame([(w,) for w in sorted(text_files.read_protected_words(spark, _written(words, "protected")))], "word string")


def qrels_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null and toxic is not null")
    lines = F.explode(F.array(F.concat_ws("\t ", F.lit("q1"), F.lit("0"), "doc_id", "quality", F.lit("more")), F.concat_ws(" ", F.lit("q2"), F.lit("0"), "doc_id", "toxic"), F.concat_ws(" ", F.lit("q3"), "doc_id", "toxic"), F.concat_ws(" ", F.lit("q4"), F.lit("0"), "doc_id", F.lit("x"))))
    return text_files.read_qrels(spark, _written(rows.select(lines), "qrels")).select("qid", F.col("doc_id").cast("long").alias("doc_id"), F.col("rel").cast("long").alias("rel"))


def ranked_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved by rank and read back: scores have four decimals by then."""
    path = workspace.fresh(spark, "ranked")
    sinks.save_ranked_results(catalog.bm25_top10(spark, sf_dir), path)
    return text_files.read_results(spark, path).select("qid", F.col("doc_id").cast("long").alias("doc_id"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def boolean_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the one file and their places: by number of query and document."""
    path = workspace.fresh(spark, "boolean") + ".csv"
    sinks.save_boolean_results(boolean.search_many(catalog.indexed(spark, sf_dir), catalog.BOOLEAN), path, one_file=True)
    return places.numbered(text_files.lines(spark, path), "seq").select("place", "line")


def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the one dump file and their places."""
    path = workspace.fresh(spark, "index") + ".txt"
    at = catalog.indexed(spark, sf_dir)
    sinks.save_index(at.postings, path, one_file=True, lists=at.lists, term_stats=at.term_stats)
    return text_files.numbered_lines(spark, path).select("place", _digest("line"))


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index read back: postings beside the stored df, length and norm."""
    at = catalog.indexed(spark, sf_dir, LATIN)
    rows = at.only(["apache", "license", "the"]).join(at.term_stats, "term").join(at.doc_stats, "doc_id").join(at.norms, "doc_id")
    return rows.select("term", "doc_id", F.col("pos").cast("long").alias("pos"), "df", "dl", F.round("norm", 6).alias("norm"))


def display_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen rows and the row that says how many more."""
    run = catalog._ranked(spark, sf_dir, "bm25", {"5": catalog.RANKED["5"]}, 50).withColumn("score", F.round("score", 4))
    return display.ranked_rows(run, "bm25").select(F.col("rank").cast("long").alias("rank"), "place", "doc_id", "score", "confidence", "details")


def display_ranked_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a query without results."""
    run = catalog._ranked(spark, sf_dir, "cosine", {"9": "nosuchwordanywhere"}, 50)
    return display.ranked_rows(run, "cosine").select(F.col("rank").cast("long").alias("rank"), "place", "doc_id", "score", "confidence", "details")


def result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one query's documents in the order in which search() returns them."""
    return places.stored_order(boolean.search(catalog.indexed(spark, sf_dir), "license OR apache"))


def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interactive search's rows: at most 500."""
    rows = SearchEngine(catalog.indexed(spark, sf_dir)).dispatch(catalog.RANKED["2"], "ranked", "bm25")
    return spark.createDataFrame([(r["doc_id"], float(r["score"])) for r in rows], "doc_id long, score double").select("doc_id", F.round("score", 4).alias("score"))


def evaluated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation command over a judgement file and a result file."""
    at = workspace.fresh(spark, "evaluation")
    labels = _table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
    sinks.save_lines(labels.select(F.explode(F.array(*[F.concat_ws(" ", F.lit(q), F.lit("0"), "doc_id", "quality") for q in catalog.RANKED]))), f"{at}/qrels.txt", one_file=True)
    run = catalog._ranked(spark, sf_dir, "bm25", catalog.RANKED, 50)
    sinks.save_ranked_results(run.withColumn("score", (100 - F.col("rank")).cast("double")), f"{at}/run.csv", one_file=True)
    row = cli.main(["evaluate", "--qrels", f"{at}/qrels.txt", "--results", f"{at}/run.csv", "--k", "10"], spark)
    return spark.createDataFrame([tuple(row[c] for c in ("map", "mrr", "p_at_k", "r_at_k"))], "map double, mrr double, p_at_k double, r_at_k double").select(*[F.round(c, 6).alias(c) for c in ("map", "mrr", "p_at_k", "r_at_k")])


_NO_XML_SQL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]".replace("\\\\", "\\")
_WHOLE_SQL = f"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{_NO_XML_SQL}', '', 'g'), '\\r\\n?', chr(10), 'g'), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')"
_LINE_SQL = r"trim(regexp_replace(coalesce(text, ''), '[\s\x0B]+', ' ', 'g'))"
_ARTICLES_SQL = f"SELECT doc_id, coalesce(lang, '') AS headline, md5({_WHOLE_SQL}) AS text, md5(coalesce(lang, '') || ' ' || {_WHOLE_SQL}) AS full_text FROM documents WHERE doc_id IS NOT NULL AND trim(coalesce(lang, '') || {_WHOLE_SQL}) <> ''"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (articles_scan, articles_rootless_scan, articles_order, articles_split_scan, query_file, query_files_in_order, stopword_file, protected_file, qrels_file, ranked_file, boolean_file, index_file, stored_postings, display_ranked, display_ranked_none, result_order, dispatched, evaluated_files)}

ORACLE_SQL: dict[str, str] = {
    "articles_scan": _ARTICLES_SQL,
    "articles_rootless_scan": _ARTICLES_SQL,
    "articles_order": f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE doc_id IS NOT NULL AND trim(coalesce(lang, '') || {_WHOLE_SQL}) <> ''",
    "articles_split_scan": _ARTICLES_SQL,
    "query_file": f"SELECT item_id AS qid, {_LINE_SQL} AS text FROM benchmark WHERE {_LINE_SQL} <> ''",
    "query_files_in_order": f"SELECT item_id AS qid, trim(CASE item_id % 2 WHEN 1 THEN 'new ' ELSE 'old ' END || {_LINE_SQL}) AS text FROM benchmark",
    "stopword_file": "SELECT n_name AS word FROM nation",
    "protected_file": "SELECT n_name AS word FROM nation UNION SELECT 'اي' || n_name FROM nation",
    "qrels_file": "SELECT DISTINCT 'q1' AS qid, doc_id, CAST(quality AS BIGINT) AS rel FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL UNION ALL SELECT DISTINCT 'q2', doc_id, CAST(toxic AS BIGINT) FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "ranked_file": catalog.ORACLE_SQL["bm25_top10"],
    "boolean_file": f"SELECT row_number() OVER (ORDER BY CAST(qid AS INT), doc_id) - 1 AS place, qid || ',' || doc_id AS line FROM ({catalog.ORACLE_SQL['batch_boolean']})",
    "index_file": f"{catalog._BASE}, {catalog._STATS}, lines AS (SELECT term, -1 AS d, term || ':' || df AS line FROM df UNION ALL SELECT term, doc_id, chr(9) || doc_id || ': ' || string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FROM postings GROUP BY term, doc_id) SELECT row_number() OVER (ORDER BY term, d) - 1 AS place, md5(line) AS line FROM lines",
    "stored_postings": f"{catalog._BASE}, {catalog._STATS}, w AS (SELECT doc_id, (1 + log10(tf)) * log10(n / df) AS w FROM tf JOIN df USING (term), n), norm AS (SELECT doc_id, round(CASE WHEN sum(w * w) = 0 THEN 1e0 ELSE sqrt(sum(w * w)) END, 6) AS norm FROM w GROUP BY ALL) SELECT term, doc_id, pos, df, CAST(dl AS BIGINT) AS dl, norm FROM postings JOIN df USING (term) JOIN dl USING (doc_id) JOIN norm USING (doc_id) WHERE term IN ('apache', 'license', 'the')",
    "display_ranked": catalog._ranked_sql("bm25", {"5": catalog.RANKED["5"]}, "SELECT CAST(rank AS BIGINT) AS rank, CAST(rank AS VARCHAR) AS place, CAST(doc_id AS VARCHAR) AS doc_id, printf('%.4f', round(score, 4)) AS score, CASE WHEN rank <= 3 THEN '🟢 Top 3' WHEN rank <= 10 THEN '🟡 Top 10' ELSE '⚪ Classé' END AS confidence, 'Score: ' || printf('%.4f', round(score, 4)) AS details FROM ranked WHERE rank <= 15 UNION ALL SELECT 16, '...', '+' || (least(count(*), 50) - 15), '', '', '' FROM ranked HAVING count(*) > 15"),
    "display_ranked_none": "SELECT 1::BIGINT AS rank, '1' AS place, 'Aucun' AS doc_id, '0.0000' AS score, '-' AS confidence, 'Aucun résultat' AS details",
    "dispatched": catalog._ranked_sql("bm25", {"2": catalog.RANKED["2"]}, "SELECT doc_id, round(score, 4) AS score FROM ranked WHERE rank <= 500"),
    "evaluated_files": catalog.ORACLE_SQL["eval_metrics"],
    "result_order": f"WITH {catalog._TOKENS} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM tok WHERE {catalog._has('license')} OR {catalog._has('apache')}",
}

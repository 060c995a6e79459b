"""Article corpora in XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexigrove.sources import xml_ranges

ARTICLE = StructType([StructField("ID", StringType()), StructField("HEADLINE", StringType()), StructField("TEXT", StringType())])
_COMMENT = re.compile("<!--.*?-->", re.DOTALL)
PARSED = "file string, start long, nth long, id string, headline string, text string"


def _parse(content: bytes) -> list[dict]:
    """The articles of a file, in the order in which they end. A file that isn't well formed is read again without comments and,
    unless it has a declaration, inside a root of its own, in the order in which articles begin; where that fails too it has none."""
    try:
        puller = xml_ranges.Puller()
        found = list(puller.feed(content))
        puller.close()
        return found
    except ET.ParseError:
        pass
    try:
        bare = _COMMENT.sub("", content.decode()).strip()
        root = ET.fromstring((bare if bare.startswith("<?xml") else f"<root>{bare}</root>").encode())
    except (ET.ParseError, UnicodeDecodeError):
        return []
    first = [{tag.lower(): article.find(tag) for tag in ("ID", "HEADLINE", "TEXT")} for article in root.findall(".//Article")]
    return [{tag: x.text if x is not None else None for tag, x in each.items()} for each in first]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out = [{"file": file, "start": 0, "nth": nth} | article for nth, article in enumerate(_parse(content))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("id", pa.string()), ("headline", pa.string()), ("text", pa.string())]))


def _strip(name: str):
    return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"(?U)^\s+|\s+$", "")


def extract(rows: DataFrame) -> DataFrame:
    """(id, headline, text, full_text, doc_seq) of rows (id, headline, text, doc_seq): stripped; those without an id or
    without any text are dropped."""
    rows = rows.select(_strip("id").alias("id"), _strip("headline").alias("headline"), _strip("text").alias("text"), "doc_seq")
    rows = rows.withColumn("full_text", F.concat("headline", F.lit(" "), "text"))
    return rows.where((F.col("id") != "") & (F.trim("full_text") != "")).select("id", "headline", "text", "full_text", "doc_seq")


def read_articles(spark: SparkSession, path: str, strict: bool = True, split_bytes: int | None = None) -> DataFrame:
    """The articles under `path`, in the order of paths and of places in them.

    strict parses byte ranges of at most split_bytes with a real parser (xml_ranges): text before an element's first child, the
    first of repeated children, files without a root. The parsed articles are written once under the workspace. Files that
    cannot be parsed so, each held whole by one task, are read by _parse(). Otherwise Spark's own XML reader is used, for flat
    files with a root; it raises on rows that it could not parse. A missing path raises in either mode.
    """
    if strict:
        rows, files, whole = xml_ranges.scan(spark, path, split_bytes)
        if whole:
            each = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
            rows = rows.unionByName(each.where(F.col("file").isin(whole)).mapInArrow(_rows, PARSED))
        places = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "in_file string, place long")
        # An article has a byte at least, so where its range starts and its number in it order a file's articles.
        fits = F.when((F.col("place") < 1 << 21) & (F.col("start") < 1 << 41), F.col("place") * F.lit(1 << 42) + F.col("start") + F.col("nth"))
        seq = F.coalesce(fits, F.raise_error(F.lit("more than 2^21 files, or one of over 2 TB")).cast("long"))
        rows = rows.join(F.broadcast(places), F.col("file") == F.col("in_file"))
        return extract(rows.select("id", "headline", "text", seq.alias("doc_seq")))
    schema = StructType([*ARTICLE.fields, StructField("_corrupt_record", StringType())])
    rows = spark.read.format("xml").option("rowTag", "Article").option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).load(path)
    sound = F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(F.lit("an article could not be parsed; read the file with strict=True"))).otherwise(F.col("ID"))
    return extract(rows.select(sound.alias("id"), F.col("HEADLINE").alias("headline"), F.col("TEXT").alias("text"), F.monotonically_increasing_id().alias("doc_seq")))


def last_by_id(articles: DataFrame) -> DataFrame:
    """A document store: for a repeated id the last content, at the first one's place."""
    last = F.max(F.struct("doc_seq", "headline", "text", "full_text")).alias("x")
    return articles.groupBy("id").agg(F.min("doc_seq").alias("doc_seq"), last).select("id", "x.headline", "x.text", "x.full_text", "doc_seq")

"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in column expressions alone.

A text is cut at blank lines into sections, those at line ends into paragraphs, those into pieces of PIECE code points.
Cutting loses nothing, so equal roots mean equal texts. A fingerprint is written as

    root:section;section;...   section = digest=paragraph,paragraph,...   paragraph = digest.pieces run together

A piece's digest is its MD5, a paragraph's the MD5 of its pieces', a section's that of its paragraphs', the root that of the
sections', all of them full; what is written below the root are the first 8 hex digits of each. Two trees are compared from
the root down: equal roots are equal texts; equal sections, then equal paragraphs of the others, count whole; pieces are only
compared in paragraphs that differ, which is where the edits are.

Defined results: a null text counts as empty and has one empty piece; an empty table gives an empty one; a text of any length
is one tree, a quarter longer than itself; repeated rows each give a row. Null doc_ids stand
first in the order of doc_id, in the place of the least long, which is no doc_id; rows that repeat a doc_id share their successor, and where the successor's doc_id is
repeated, its least text counts. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.scratch import Scratch

PIECE = 32
_FIRST = -(1 << 63)


def _digest(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def fingerprint(text: Column, piece: int = PIECE) -> Column:
    """The fingerprint of one text, as a string."""
    leaf = lambda p: F.when(p == "", F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(f"(?s)(.{{1,{piece}}})"), 1))
    short = lambda c: F.substring(c, 1, 8)

    def branch(digests: Column, written: Column) -> Column:
        """A node over its children's digests, and how it is written."""
        return F.struct(_digest(F.array_join(digests, "")).alias("digest"), written.alias("written"))

    def paragraph(p: Column) -> Column:
        return _once(F.transform(leaf(p), _digest), lambda x: branch(x, F.array_join(F.transform(x, short), "")))

    def over(nodes: Column, mark: str, between: str) -> Column:
        shown = F.transform(nodes, lambda n: F.concat(short(n["digest"]), F.lit(mark), n["written"]))
        return branch(F.transform(nodes, lambda n: n["digest"]), F.array_join(shown, between))

    section = lambda s: _once(F.transform(F.split(s, "\n"), paragraph), lambda x: over(x, ".", ","))
    tree = _once(F.transform(F.split(text, "\n\n"), section), lambda x: over(x, "=", ";"))
    return _once(tree, lambda t: F.concat(t["digest"], F.lit(":"), t["written"]))


def _below(fp: Column) -> Column:
    return F.split(F.substring(fp, 34, 2**31 - 1), ";")


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring(s, 10, 2**31 - 1), ",")))


def _size(paragraphs: Column) -> Column:
    """How many pieces paragraphs have."""
    return F.aggregate(paragraphs, F.lit(0), lambda n, p: n + ((F.length(p) - 9) / 8).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """1 where the roots agree; else 2 c / (2 c + max(x + y, 1)), under 1, where c counts the pieces of distinct common sections, of
    distinct common paragraphs of the other sections, and the distinct common pieces of the other paragraphs, x and y the
    distinct pieces that only one has. Texts that differ in the order or number of equal parts alone count as one piece apart."""
    both = lambda x, y: F.struct(F.array_intersect(x, y).alias("common"), F.array_except(x, y).alias("a"), F.array_except(y, x).alias("b"))
    pieces = lambda paragraphs: F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(F.substring(p, 10, 2**31 - 1), F.lit("([0-9a-f]{8})"), 1)))

    def leaves(whole: Column, x: Column, y: Column) -> Column:
        common = whole + F.size(F.array_intersect(x, y))
        apart = F.greatest(F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)), F.lit(1))
        return 2.0 * common / (2 * common + apart)

    def paragraphs(whole: Column, x: Column, y: Column) -> Column:
        return _once(both(x, y), lambda p: _once(F.struct((whole + _size(p["common"])).alias("whole"), pieces(p["a"]).alias("x"), pieces(p["b"]).alias("y")), lambda q: leaves(q["whole"], q["x"], q["y"])))

    sections = _once(both(_below(a), _below(b)), lambda s: _once(F.struct(_size(_paragraphs(s["common"])).alias("whole"), _paragraphs(s["a"]).alias("x"), _paragraphs(s["b"]).alias("y")), lambda q: paragraphs(q["whole"], q["x"], q["y"])))
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.lit(1.0)).otherwise(sections)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>, counted from 0: the paragraphs of `a` that `b` lacks at that place."""
    none = F.expr("array()").cast("array<struct<section:int,paragraph:int>>")

    def inside(section: Column, i: Column, other: Column) -> Column:
        of = lambda s: F.split(F.substring(s, 10, 2**31 - 1), ",")
        there = of(F.coalesce(other, F.lit("")))
        each = _once(there, lambda t: F.transform(of(section), lambda p, j: F.when(~p.eqNullSafe(F.get(t, j)), F.struct(i.alias("section"), j.alias("paragraph")))))
        return F.when(section.eqNullSafe(other), none).otherwise(F.filter(each, lambda x: x.isNotNull()))

    changed = _once(_below(b), lambda others: F.flatten(F.transform(_below(a), lambda s, i: inside(s, i, F.get(others, i)))))
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), none).otherwise(changed)


def _successors(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, follows, need): for each key the one it follows in ascending order, after the last the first, and the most
    code points its predecessor takes. Ids are dealt by range and written, so the order needs no single task; only the
    ranges' first keys, one row per partition, meet in one."""
    ids = rows.groupBy("key").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("need"))
    ids = scratch.keep(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ids")
    heads = ids.groupBy("part").agg(F.min("key").alias("head"))
    after = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("next_head"), F.min("head").over(Window.partitionBy(F.lit(1))).alias("least"))
    within = ids.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    pairs = within.join(F.broadcast(after), "part")
    return pairs.select(F.coalesce("next_key", "next_head", "least").alias("key"), F.col("key").alias("follows"), "need")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text: the last n_chars div 4 code points replaced by as many from the start
    of the next document. Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and changed: how many
    paragraphs of the edited text the tree shows to differ.

    Two exchanges: the texts once by doc_id, and to each predecessor the start and the fingerprint of its successor.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    # The key stands for doc_id, so that both uses of the texts need the same columns and share one exchange.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = rows.join(scratch.keep(_successors(rows, scratch), "successors"), "key")
    sent = placed.select(F.col("follows").alias("key"), F.struct(F.expr("substring(text, 1, need)").alias("start"), fingerprint(F.col("text")).alias("fp")).alias("successor"))
    sent = sent.groupBy("key").agg(F.min("successor").alias("successor"))
    n = F.length("text")
    both = rows.join(sent, "key").withColumn("doc_id", F.nullif("key", F.lit(_FIRST)))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.expr("substring(successor.start, 1, cast(length(text) div 4 as int))")).alias("edited"), "text", F.col("successor.fp").alias("next_fp"))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fp")
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"), F.size(changed_paragraphs(F.col("edited_fingerprint"), F.col("fingerprint"))).cast("long").alias("changed"))

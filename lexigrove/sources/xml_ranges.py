"""Article files parsed strictly in byte ranges, each record held alone.

Spark's text reader cuts files into ranges and, with the end tag of an article as its line separator, begins each range at the
first article after its start; so any store that Spark reads will do, and no file and no tree is held whole. What a real parser
needs to begin in mid-file is found in two scans:

1. Each range tells what it does to the parser's state for each state in which it might begin (in text, a comment, a CDATA section
   or a processing instruction): the state it ends in, how many elements it closes that it didn't open, and the start tags it
   leaves open. These few bytes, folded in the order of a file's ranges, give the start tags that are open where each begins.
2. Each range goes through a pull parser behind those start tags, so entities, namespaces, encodings and well-formedness are the
   parser's own, and before the end tags that should follow, so a wrong fold can't pass. An element is dropped once it has ended.

A file with a range that fails is tried once more as one without a root, inside a root of its own, and a file that fails there,
has a document type, or has a range that begins within an article (whose own text then holds an end tag), is left to the whole-file parser.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.sources import workspace

TAG = "Article"
END = f"</{TAG}>".encode()
#: The states in which a range may begin, with what opens and what ends each.
STATES = ((b"", b""), (b"<!-- ", b"-->"), (b"<![CDATA[", b"]]>"), (b"<?x ", b"?>"))
MARKUP = re.compile(
    rb"""<!--.*?(?P<comment>-->|\Z)|<!\[CDATA\[.*?(?P<cdata>\]\]>|\Z)|<\?.*?(?P<pi>\?>|\Z)|(?P<doctype><!DOCTYPE)
    |<(?P<close>/?)[^\s/>!?"'<]+(?:[^<>"']|"[^"]*"|'[^']*')*?(?P<empty>/?)>""",
    re.DOTALL | re.VERBOSE,
)
ENCODING = re.compile(rb"""\s*<\?xml[^>]*encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")
NAME = re.compile(rb"<([^\s/>]+)")
#: Ranges up to this many get their start by broadcast; more by a shuffle that puts records back in order.
FEW_RANGES = 200_000

RANGES = "file string, start long, size long, bytes long, encoding binary, doctype boolean, effects array<struct<state:int,closed:int,opened:array<binary>>>"
STARTS = "in_file string, at_start long, before binary, after binary, unended boolean"
PARSED = "file string, start long, nth long, id string, headline string, text string, failed boolean"


def _lexed(record: bytes, begin: int) -> tuple[int, int, list[bytes], bool]:
    """(state, elements closed, start tags left open, whether a document type is declared) after record[begin:], from text."""
    state, closed, opened, doctype = 0, 0, [], False
    for m in MARKUP.finditer(record, begin):
        kind = m.lastgroup
        if kind in ("comment", "cdata", "pi"):
            if not m[kind]:
                state = ("", "comment", "cdata", "pi").index(kind)
        elif kind == "doctype":
            doctype = True
        elif m["close"]:
            if opened:
                opened.pop()
            else:
                closed += 1
        elif not m["empty"]:
            opened.append(m[0])
    return state, closed, opened, doctype


class _Effects:
    """What the records of a range do, for each state in which it may begin."""

    def __init__(self):
        self.now = [(state, 0, []) for state in range(len(STATES))]
        self.bytes, self.doctype = 0, False

    def add(self, record: bytes) -> None:
        self.bytes += len(record)
        known: dict[int, tuple] = {}
        for i, (state, closed, opened) in enumerate(self.now):
            begin = 0
            if state:
                found = record.find(STATES[state][1])
                if found < 0:
                    continue
                begin = found + len(STATES[state][1])
            if begin not in known:
                known[begin] = _lexed(record, begin)
            after, out, more, doctype = known[begin]
            self.doctype |= doctype
            both = max(0, len(opened) - out)
            self.now[i] = (after, closed + max(0, out - len(opened)), opened[:both] + more)


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row without its last column, whether a range begins, record) of rows that end with a record; a task reads its ranges one after another."""
    last = None
    for batch in batches:
        for *head, record in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
            yield head, head[:2] != last, record
            last = head[:2]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each range, from rows (file, start, size, record)."""

    def rows() -> Iterator[dict]:
        now, effects = None, _Effects()
        for (file, start, size), begins, record in _by_range(batches):
            if begins:
                if now:
                    yield now | done(effects)
                found = ENCODING.match(record.removeprefix(b"\xef\xbb\xbf")) if start == 0 else None
                now, effects = {"file": file, "start": start, "size": size, "encoding": found[1] if found else None}, _Effects()
            effects.add(record + END)
        if now:
            yield now | done(effects)

    def done(effects: _Effects) -> dict:
        return {"bytes": effects.bytes, "doctype": effects.doctype, "effects": [{"state": s, "closed": c, "opened": o} for s, c, o in effects.now]}

    effect = pa.struct([("state", pa.int32()), ("closed", pa.int32()), ("opened", pa.list_(pa.binary()))])
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("encoding", pa.binary()), ("doctype", pa.bool_()), ("effects", pa.list_(effect))])
    for row in rows():
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def _folded(rooted: bool) -> Callable[[pa.Table], pa.Table]:
    """A function from a file's ranges to what stands before and after each; none where the file must be parsed whole."""

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        out: list[dict] = []
        over = sum(r["bytes"] for r in rows) - rows[0]["size"]  # the reader drops a byte order mark of three
        fits = over in (0, -3, len(END), len(END) - 3) and not any(r["doctype"] for r in rows)
        state, stack = 0, [] if rooted else [b"<root>"]
        declared = b"<?xml version='1.0' encoding='%s'?>" % rows[0]["encoding"] if rows[0]["encoding"] else b""
        for i, r in enumerate(rows):
            if any(NAME.match(t)[1] == TAG.encode() for t in stack):
                fits = False
            at_root = b"<root/>" if i and not stack else b""
            before = (declared if i else b"") + (at_root or b"".join(stack)) + STATES[state][0]
            effect = r["effects"][state]
            state = effect["state"]
            if effect["closed"] > len(stack) - (not rooted) and i + 1 < len(rows):
                fits = False
            stack = stack[: max(0, len(stack) - effect["closed"])] + effect["opened"]
            end = b"".join(b"</%s>" % NAME.match(t)[1] for t in reversed(stack))
            last = i + 1 == len(rows)
            after = (b"" if rooted else b"</root>") if last else STATES[state][1] + end
            out.append({"in_file": r["file"], "at_start": r["start"], "before": before, "after": after, "unended": last and over > 0})
        return pa.Table.from_pylist(out if fits else [], schema=pa.schema([("in_file", pa.string()), ("at_start", pa.int64()), ("before", pa.binary()), ("after", pa.binary()), ("unended", pa.bool_())]))

    return fold


class Puller:
    """Articles of a text that comes in pieces, in the order in which they end; what has ended is dropped."""

    def __init__(self):
        self.parser = ET.XMLPullParser(events=("start", "end"))
        self.open: list[ET.Element] = []
        self.inside, self.nested = 0, False

    def feed(self, piece: bytes) -> Iterator[dict]:
        self.parser.feed(piece)
        for event, element in self.parser.read_events():
            article = element.tag == TAG
            if event == "start":
                self.open.append(element)
                self.inside += article
                self.nested |= self.inside > 1
                continue
            self.open.pop()
            if article:
                self.inside -= 1
                first = {tag: element.find(tag) for tag in ("ID", "HEADLINE", "TEXT")}
                yield {tag.lower(): x.text if x is not None else None for tag, x in first.items()}
                element.clear()
            if self.open and not self.inside:
                self.open[-1].remove(element)

    def close(self) -> None:
        self.parser.close()


def _pulled(rooted: bool) -> Callable:
    """A function from rows (file, start, before, after, unended, record) to articles, and a row that says so where a range fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("id", pa.string()), ("headline", pa.string()), ("text", pa.string()), ("failed", pa.bool_())])
        held: list[dict] = []
        for row in _articles(_by_range(batches), rooted):
            held.append(row)
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def _articles(rows: Iterator[tuple], rooted: bool) -> Iterator[dict]:
    head, puller, nth, waiting = None, None, 0, b""

    def failure() -> dict:
        nonlocal puller
        puller = None
        return {"file": head[0], "start": head[1], "nth": nth, "failed": True}

    def take(piece: bytes, close: bool = False) -> Iterator[dict]:
        nonlocal nth
        if puller is None:
            return
        try:
            for article in puller.feed(piece):
                yield {"file": head[0], "start": head[1], "nth": nth} | article
                nth += 1
            if close:
                puller.close()
        except ET.ParseError:
            yield failure()
        else:
            # The whole-file parser takes comments out of the text before it parses a file without a root, from CDATA sections too,
            # and gives articles within articles in another order.
            if not rooted and (puller.nested or b"<![CDATA[" in piece):
                yield failure()

    for now, begins, record in rows:
        if begins:
            if head:
                yield from take(waiting + (b"" if head[4] else END) + (head[3] or b""), True)
            head, puller, nth = now, Puller(), 0
            if head[2] is None:  # the fold gave up on its file
                yield failure()
            else:
                yield from take(head[2])
        else:
            yield from take(waiting + END)
        waiting = record
    if head:
        yield from take(waiting + (b"" if head[4] else END) + (head[3] or b""), True)


@contextmanager
def _cut_at(spark: SparkSession, split_bytes: int | None):
    """Ranges of at most so many bytes, for scans within."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    try:
        if split_bytes:
            for name in names:
                spark.conf.set(name, str(split_bytes))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _parsed(spark: SparkSession, path: str, rooted: bool, only: list[str] | None, split_bytes: int | None) -> tuple[DataFrame, list[str]]:
    """(the written table PARSED, the files) of all files, or of some. Both scans are cut alike."""
    records = _records(spark, path)
    records = records if only is None else records.where(F.col("file").isin(only))
    at, starts_at, out = (workspace.fresh(spark, f"xml-{name}") for name in ("ranges", "starts", "articles"))
    with _cut_at(spark, split_bytes):
        records.mapInArrow(_summaries, RANGES).write.parquet(at)
    ranges = spark.read.parquet(at)
    files = sorted(r["file"] for r in ranges.select("file").distinct().collect())
    ranges.groupBy("file").applyInArrow(_folded(rooted), STARTS).write.parquet(starts_at)
    starts = spark.read.parquet(starts_at)
    on = (F.col("file") == F.col("in_file")) & (F.col("start") == F.col("at_start"))
    if starts.limit(FEW_RANGES + 1).count() <= FEW_RANGES:
        rows = records.join(F.broadcast(starts), on, "left")
    else:
        rows = records.withColumn("place", F.monotonically_increasing_id()).join(starts, on, "left")
        rows = rows.repartition("file", "start").sortWithinPartitions("file", "start", "place")
    with _cut_at(spark, split_bytes):
        rows.select("file", "start", "before", "after", "unended", "record").mapInArrow(_pulled(rooted), PARSED).write.parquet(out)
    return spark.read.parquet(out), files


def _records(spark: SparkSession, path: str) -> DataFrame:
    m = F.col("_metadata")
    return spark.read.option("lineSep", END.decode()).text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("start"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("record"))


def scan(spark: SparkSession, path: str, split_bytes: int | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(articles, all files, files left to the whole-file parser): articles (file, start, nth, id, headline, text) of the other files,
    read and written once; `start` and `nth` order a file's articles. The names of files pass the driver, which lists them anyway.
    split_bytes bounds a range; the session's spark.sql.files.maxPartitionBytes does where it isn't given."""
    found, files, left = None, None, None
    for rooted in (True, False):
        if left == []:
            break
        rows, names = _parsed(spark, path, rooted, left, split_bytes)
        files = names if files is None else files
        left = sorted(r["file"] for r in rows.where("failed").select("file").distinct().collect())
        rows = rows.where(F.col("failed").isNull() & ~F.col("file").isin(left) if left else F.col("failed").isNull())
        found = rows if found is None else found.unionByName(rows)
    return found.drop("failed"), files, left

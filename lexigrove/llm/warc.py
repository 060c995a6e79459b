"""WARC archives: a writer made of column expressions, and a reader that salvages damaged files.

Writer: one record per row of (page_id, url, html). A null html is an empty payload, a null url is `urn:x-none`, white
space in a url is percent-encoded. Of rows with equal payloads of at least `least` bytes, those with the smallest
page_id are responses and the others revisit it; rows repeating that smallest id are responses too, and null ids
revisit. Other columns are never read. Reader: see salvage().
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Generator, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.scratch import Scratch

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PER_FILE = 2000
#: An archive file has about so many bytes, or one record; pages over LARGE go to files of their own.
FILE_BYTES, LARGE = 256 << 20, 128 << 10


def _url():
    return F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("urn:x-none")), r"(?U)\s", "%20")


def write(pages: DataFrame, path: str, scratch: Scratch, least: int = 100, date: str = "2024-01-01T00:00:00Z", per_file: int = PER_FILE) -> None:
    """Write the archives under `path` (any store Spark writes to), uncompressed, at most `per_file` records and about FILE_BYTES
    a file: pages over LARGE are written apart, so many to a file as fit if all are as long as the longest.

    Each row becomes one string, header, blank line and block; the text writer's line separator is the blank pair of
    lines that ends a WARC record. Only digests of repeated payloads are joined to the pages. That join is on equal
    keys with both sides exchanged, so AQE can split the partition of a payload that very many pages share.
    """
    rows = pages.select(F.col("page_id").cast("long"), _url().alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha2("html", 256))
    firsts = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    rows = rows.join(scratch.keep(firsts, "repeated"), "digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        F.when(again, F.concat(line("WARC-Refers-To", urn("first")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    rows = rows.withColumn("block", block).withColumn("record", F.concat(header, F.lit(CRLF), F.col("block")))
    longest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    for name, some, most in (("small", F.col("n") <= LARGE, LARGE), ("large", F.col("n") > LARGE, longest)):
        if longest > LARGE or name == "small":
            rows.where(some).select("record").write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", max(1, min(per_file, FILE_BYTES // (most + 2048)))).text(f"{path}/{name}")


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: A member is read and inflated in steps of so many bytes; a damaged one in finer ones, which tell where its last sound record ends.
FED, STEP, FINE = 16 << 10, 64 << 10, 64
CUT, ENDLESS = "member without end", "header without end"


def _record(data: bytes | bytearray, at: int) -> tuple[dict | None, int, str]:
    """The plain record that starts at `at`, the offset after it (as declared; `at` where nothing is), and why there is none."""
    if not _VERSION.match(data, at):
        return None, at, "no version line"
    if (stop := data.find(b"\r\n\r\n", at)) < 0:
        return None, at, ENDLESS
    fields = {}
    for raw in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = raw.partition(b":")
        if not colon:
            return None, at, "header line without colon"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not length.isascii() or not length.isdigit():
        return None, at, "no type or length"
    body, end = stop + 4, stop + 4 + int(length[:18])
    if data[end : end + 4] != b"\r\n\r\n":
        return None, end + 4, "block without terminator"
    block = bytes(data[body:end])
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        return None, end + 4, "block digest differs"
    return {"fields": fields, "block": block, "vouched": kind == "sha256"}, end + 4, ""


def _onward(data: bytes | bytearray, at: int, after: int, start: re.Pattern, whole: bool = True) -> int:
    """Where the search goes on when what starts at `at` failed: at `after`, its declared end, if something starts or all data ends
    there, so that nothing inside a damaged block counts; else at the next start, or where one may begin that `data` cuts off."""
    if after > at and (start.match(data, after) or whole and after == len(data)):
        return after
    step = start.search(data, at + 1)
    return step.start() if step else len(data) if whole else max(at + 1, len(data) - 9)


def _deflated(data: bytes, at: int) -> int | None:
    """Where the deflate stream of the gzip member at `at` begins; None if its header is unsound."""
    if at + 10 > len(data) or (flags := data[at + 3]) & 0xE0:
        return None
    to = at + 10
    if flags & 4:
        to += 2 + int.from_bytes(data[to : to + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            if (end := data.find(b"\0", to)) < 0:
                return None
            to = end + 1
    to += 2 if flags & 2 else 0
    return to if to <= len(data) else None


def _inflate(data: bytes, at: int, step: int) -> Generator[tuple[bytes, int], None, tuple[int, str]]:
    """Pieces of at most `step` bytes of what the member at `at` inflates to, each with the offset read up to; returns the member's
    end and why it is unsound, if so."""
    if (fed := _deflated(data, at)) is None:
        return at, "member without header"
    inflate, left, crc, size = zlib.decompressobj(-15), b"", 0, 0
    while not inflate.eof:
        if not left:
            left = data[fed : fed + FED]
            fed += len(left)
        last = not left
        try:
            piece = inflate.decompress(left, step)
        except zlib.error as e:
            return fed - len(left), f"member does not inflate: {e}"
        if last and not piece and not inflate.eof:
            return len(data), CUT
        left = inflate.unconsumed_tail
        crc, size = zlib.crc32(piece, crc), size + len(piece)
        if piece:
            yield piece, fed - len(inflate.unused_data if inflate.eof else left)
    end = fed - len(inflate.unused_data)
    if len(trailer := data[end : end + 8]) < 8:
        return len(data), CUT
    sound = trailer == crc.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little")
    return end + 8, "" if sound else "member checksum differs"


def _member(data: bytes, at: int) -> tuple[int, str]:
    """The end of the member at `at`, and why it is unsound, if so; nothing is held."""
    pieces = _inflate(data, at, STEP)
    while True:
        try:
            next(pieces)
        except StopIteration as end:
            return end.value


def _inside(data: bytes, at: int, why: str) -> Iterator[dict]:
    """Records and gaps of what the member at `at` inflates to, by inner offset and length; `why` tells what is wrong with the member.

    One record's bytes are held. `reach` is the offset read up to when a record ended; a gap at the end is a `tail`. Where the
    member's bytes are known to be altered, only records with a digest of their own are sound.
    """
    altered = why not in ("", CUT)
    held, base, pos, wanted, bad, reason, reach = bytearray(), 0, 0, 0, None, "", at
    for piece, upto in chain(_inflate(data, at, FINE if why else STEP), [(b"", None)]):
        held += piece
        end, reach = upto is None, upto or reach
        if len(held) < wanted and not end:
            continue
        while pos < len(held):
            record, after, failed = _record(held, pos)
            # What follows a failed record's declared end has to be seen, too.
            if failed and not end and (failed == ENDLESS or len(held) < max(after, pos) + 10):
                wanted = 2 * len(held) if failed == ENDLESS else after if len(held) < after else max(after, pos) + 10
                break
            if record and altered and not record["vouched"]:
                record, failed = None, "no digest in an altered member"
            if record:
                if bad is not None:
                    yield {"inner_offset": bad, "inner_length": base + pos - bad, "gap": reason}
                yield {"inner_offset": base + pos, "inner_length": after - pos, "reach": reach, **record}
                pos, bad = after, None
            else:
                if bad is None:
                    bad, reason = base + pos, failed
                pos = _onward(held, pos, after, _VERSION, end)
        del held[:pos]
        base, wanted, pos = base + pos, wanted - pos, 0
    if bad is not None:
        yield {"inner_offset": bad, "inner_length": base - bad, "gap": reason, "tail": True}


def salvage(data: bytes) -> Iterator[dict]:
    """All sound records of an archive and every byte range that belongs to none, in order, covering all of `data`.

    An archive is a run of plain records, gzip members of records, or both. A record must have a version line, type, length,
    its whole block, the terminator, and the block digest where it names one. After a failed check the search goes on behind the
    record's declared end if a record or member starts there or the archive ends, so no record inside a damaged block counts; else
    at the next version line or member. The bytes between are one quarantined gap {offset, length, gap: reason}.

    Members are inflated in steps. Records and gaps inside one have its offset and length and their own inner_offset and
    inner_length. A member that is cut short, doesn't inflate or has another checksum gives the sound records it holds (when its
    bytes are altered, those with a digest) and ends with the last of them; what follows is a gap. One without any
    is a gap as a whole. An empty archive yields nothing.
    """
    at, bad, why = 0, None, ""

    def gap(upto: int) -> Iterator[dict]:
        if bad is not None and upto > bad:
            yield {"offset": bad, "length": upto - bad, "gap": why}

    while at < len(data):
        record, after, reason = None, at, ""
        if data.startswith(_MEMBER, at):
            after, reason = _member(data, at)
            sound = (x["reach"] for x in _inside(data, at, reason) if "fields" in x)
            upto = max(sound, default=at) if reason else after if next(sound, None) else at
            if upto > at:
                yield from gap(at)
                for x in _inside(data, at, reason):
                    if not (reason and x.get("tail")):  # what ends a damaged member is in the gap behind it
                        yield {"offset": at, "length": upto - at, **x}
                bad, why = (upto, reason) if reason else (None, "")
                step = _NEXT.search(data, upto) if reason else None
                at = upto if not reason else step.start() if step else len(data)
                continue
            after, reason = (at, reason) if reason else (after, "member without records")
        else:
            record, after, reason = _record(data, at)
        if record:
            yield from gap(at)
            yield {"offset": at, "length": after - at, **record}
            at, bad = after, None
        else:
            if bad is None:
                bad, why = at, reason
            at = _onward(data, at, after, _NEXT)
    yield from gap(len(data))


READ = "file string, offset long, length long, inner_offset long, inner_length long, gap string, record_type string, record_id string, refers_to string, uri string, payload_digest string, declared_bytes long, payload binary"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner_offset", pa.int64()), ("inner_length", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()), ("declared_bytes", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, held = [], 0
            for x in salvage(content.as_py()):
                row = {"file": file.as_py(), "offset": x["offset"], "length": x["length"], "inner_offset": x.get("inner_offset"), "inner_length": x.get("inner_length"), "gap": x.get("gap")}
                if fields := x.get("fields"):
                    head, _, payload = x["block"].partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", x["block"])
                    said = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
                    row |= {"record_type": fields["warc-type"], "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest"), "declared_bytes": int(said[1]) if said else None, "payload": payload}
                    held += len(payload)
                rows.append(row)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under `path`, plain or gzip, columns as in READ. One file is one Python value; a gzip
    member is inflated record by record."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(_read_batches, READ)


def archive(pages: DataFrame) -> DataFrame:
    """Write `pages` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to. Raises if the
    reader had to quarantine any bytes, or if a revisit's length and digest are not those of the response it refers to."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write(pages, path, scratch)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:x-page:(-?[0-9]+)>$', 1) as bigint)")
    again = F.col("record_type") == "revisit"
    rows = read(spark, path).select(
        "file", "offset", "gap",
        page("record_id").alias("page_id"),
        F.when(again, F.col("declared_bytes")).otherwise(F.length("payload")).cast("long").alias("payload_bytes"),
        F.when(again, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.when(again, page("refers_to")).alias("refers_to"),
    )
    rows = scratch.keep(rows, "records")
    if lost := rows.where("gap is not null").select("file", "offset", "gap").head(5):
        raise ValueError(f"bytes that belong to no record: {[tuple(x) for x in lost]}")
    rows = rows.drop("file", "offset", "gap")
    claims = rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_bytes", "payload_digest").distinct()
    responses = rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest")
    if wrong := claims.join(responses, ["page_id", "payload_bytes", "payload_digest"], "left_anti").head(5):
        raise ValueError(f"revisits of other payloads than they name: {[tuple(x) for x in wrong]}")
    return rows

"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other.
Rows are kept as they come: repeated rows and repeated or null doc_ids each give a row, and a component's id is the
smallest non-null doc_id in it; an empty table gives an empty one. A text of any length is read whole, in memory of some 100
bytes a word. Other columns of the input are never read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.components import components
from lexigrove.llm.scratch import Scratch

SEED, SHINGLE = 42, 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of `counts` 64-bit hashes: bit set where over half of a run has it.

    Bits are summed eight at a time in the bytes of one word, over at most 255 hashes, so no byte overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full].astype(np.int64)
    pieces = -(-n // 255)
    owner = np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(n) - n, pieces) + 255 * (np.arange(pieces.sum()) - owner)
    first = np.cumsum(pieces) - pieces
    value = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        set_ = 2 * sums > n[:, None]
        for byte in range(8):
            value |= set_[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = value
    return out


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle, repeats included; of the whole sequence if it has fewer words."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower(): A-Z only
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            each = [np.array(shingle_hashes(t), np.uint64) for t in part.column(1).to_pylist()]
            fp = majority(np.concatenate(each), np.array([len(x) for x in each]))
            yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Columns (doc_id, fp): the fingerprint of every whole text, as a signed long. No shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Columns (a, b): each pair of different fingerprints within `distance` bits, once, from distinct fps (column fp).

    64 bits are cut into `blocks`; a pair that differs in at most `distance` bits agrees in at least
    blocks - distance of them, so it meets under one key for each choice of that many blocks. A pair is made only
    under the first choice it agrees in: every earlier block outside that choice must differ. Rows are fps times
    the number of choices, whatever the size of a group; exact copies are one fingerprint and make no pairs. The
    join is on equal keys with both sides exchanged, so AQE can split a hot key; that is asked for, as a table's size on
    disk doesn't tell that its rows are multiplied by the choices, and they would be broadcast.
    """
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    masks = [((1 << w) - 1) << sum(width[:i]) for i, w in enumerate(width)]
    choices = list(combinations(range(blocks), blocks - distance))
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[i] for i in c))).cast("long")) for c in choices])
    rows = fps.select("fp", F.posexplode(keys).alias("choice", "key"))
    a, b = rows.select(F.col("fp").alias("a"), "choice", "key"), rows.select(F.col("fp").alias("b"), "choice", "key")
    earlier = [[_signed(masks[j]) for j in range(c[-1]) if j not in c] for c in choices]
    most = max(map(len, earlier))
    x = F.col("a").bitwiseXOR(F.col("b"))

    def differs(k: int) -> Column:
        of = F.array(*[F.lit(e[k] if k < len(e) else -1).cast("long") for e in earlier])
        return x.bitwiseAND(F.get(of, F.col("choice"))) != 0

    joined = a.hint("merge").join(b, ["choice", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= distance))
    for k in range(most):
        joined = joined.where(differs(k))
    return joined.select("a", "b")


def near_duplicates(docs: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """Columns (doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest doc_id reachable over
    links. All links are found. Links are between distinct fingerprints; a group of exact copies is one of them.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    table = scratch.keep(fingerprints(docs), "fingerprints")
    classes = scratch.keep(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = components(close_pairs(classes.select("fp"), distance, blocks), scratch)
    linked = linked.select(F.col("node").alias("fp"), "component")
    least = linked.join(classes, "fp").groupBy("component").agg(F.min("least").alias("smallest"))
    merged = linked.join(least, "component").select("fp", "smallest")
    ids = scratch.keep(classes.join(merged, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id")), "ids")
    return table.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """docs, all columns, with one document of each group: the one whose doc_id is its component's id.

    Rows that repeat a doc_id are one document, of which the row with the least text stays. Rows without a doc_id have
    nothing to be named by and always stay.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.keep(near_duplicates(docs, distance, blocks).where("doc_id is not null"), "found")
    each = found.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("n"))
    each = scratch.keep(each, "documents")
    gone = scratch.keep(each.where("stays = 0").select(F.col("doc_id").alias("__gone")), "gone")
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    if each.where("n > 1").isEmpty():
        return kept
    order = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).orderBy("text")
    nth = next(name for i in range(len(docs.columns) + 1) if (name := f"nth{i}") not in docs.columns)
    return kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)

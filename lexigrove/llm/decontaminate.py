"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A test item is contained in a document when the document has at least `least` of the item's distinct shingles of five
words (lower-cased runs of letters and digits). Items of at most EXACT shingles are found by the hashes of their shingles,
without a chance of missing any. Larger ones are partitioned by size: one of at most S = 2^c distinct shingles is searched in windows of 2 S shingles that begin every S, so a document of any length meets an item in sets of its own
order of size, and the Jaccard similarity of an item with the window that holds it is at least 0.19 (0.8 n against 2 S,
n > S / 2). Windows whose MinHash signature agrees with an item's in any of SIGNATURE places make a candidate; the
chance to miss one window at that bound is 0.81^64, about one in a million, and far less for whole passages. Candidates are
verified on the shingles themselves, over the whole document.

Defined results: null texts and those of under five words hold no shingle, so they neither match nor contain; equal
(item_id, text) rows are one item; repeated documents each give their rows; an empty benchmark or table gives no row; ties at
`least` exactly match; texts of any length are read whole. Only doc_id and text, item_id and text are
read. Items are written and broadcast in blocks of at most BLOCK rows and BLOCK_CHARS characters, one held at a time; each
block is one pass without a shuffle, so a larger benchmark means more passes, never a larger broadcast.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.scratch import Scratch

SHINGLE, LEAST, SIGNATURE = 5, 0.8, 64
BLOCK, BLOCK_CHARS = 20_000, 16 << 20
SMALLEST, EXACT = 16, 8
WORD = re.compile(r"[^\W_]+")
REMEMBERED = 400_000
_RANDOM = np.random.default_rng(20_240_101)
_FACTORS = _RANDOM.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(int(x)) for x in _RANDOM.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + SHINGLE]) for i in range(len(ws) - SHINGLE + 1)}


class Hashes:
    """Hashes of shingles, made from remembered hashes of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _miss(self, word: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        h = self.known[word] = xxhash.xxh64_intdigest(word) or 1
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        if len(ws) < SHINGLE:
            return np.zeros(0, np.uint64)
        get, miss = self.known.get, self._miss
        h = np.array([get(w) or miss(w) for w in ws], np.uint64)
        n = len(ws) - SHINGLE + 1
        out = h[:n] * _MIX[0]
        for j in range(1, SHINGLE):
            out += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(32))) * _MIX[j]
        out ^= out >> np.uint64(29)
        return out


def _permuted(h: np.ndarray, k: int) -> np.ndarray:
    return h * _FACTORS[k]


class Items:
    """A block of items and, for each size class, what is looked up of their signatures."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashes = Hashes()
        self.rows = [(item, shingles(words(text))) for item, text in rows]
        classes: dict[int, list[int]] = defaultdict(list)
        signatures: dict[int, list[int]] = {}
        self.short: dict[int, list[int]] = defaultdict(list)
        self.short_filter = np.zeros(1 << 16, bool)
        for i, (_, own) in enumerate(self.rows):
            if 0 < len(own) <= EXACT:
                for value in set(hashes.of(words(rows[i][1])).tolist()):
                    self.short[value].append(i)
                    self.short_filter[value & 0xFFFF] = True
            elif own:
                size = max(SMALLEST, 1 << (len(own) - 1).bit_length())
                classes[size].append(i)
                h = hashes.of(words(rows[i][1]))
                signatures[i] = [int(_permuted(h, k).min()) for k in range(SIGNATURE)]
        self.classes = {}
        for size, members in sorted(classes.items()):
            where: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(SIGNATURE)]
            filters = np.zeros((SIGNATURE, 1 << 16), bool)
            for i in members:
                for k, value in enumerate(signatures[i]):
                    where[k][value].append(i)
                    filters[k, value & 0xFFFF] = True
            self.classes[size] = (where, filters)


def _minima(values: np.ndarray, counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima of consecutive runs of `step` values within each of the segments of `counts`, and the segments' new counts."""
    pieces = -(-counts // step)
    starts = np.repeat(np.cumsum(counts) - counts, pieces) + step * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return np.minimum.reduceat(values, starts), pieces


def candidates(each: list[np.ndarray], items: Items) -> set[tuple[int, int]]:
    """(document, item) numbers where a window's signature meets an item's, or a document has a shingle of a short item."""
    counts = np.array([len(h) for h in each])
    full = np.flatnonzero(counts)
    found: set[tuple[int, int]] = set()
    if not len(full):
        return found
    h, counts = np.concatenate([each[i] for i in full]), counts[full]
    if items.short:
        document = np.repeat(full, counts)
        for j in np.flatnonzero(items.short_filter[(h & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
            for i in items.short.get(int(h[j]), ()):
                found.add((int(document[j]), i))
    if not items.classes:
        return found
    for k in range(SIGNATURE):
        low, have = _minima(_permuted(h, k), counts, SMALLEST)
        at = SMALLEST
        for size, (where, filters) in items.classes.items():
            if size > at:
                low, have = _minima(low, have, size // at)
                at = size
            owner = np.repeat(np.arange(len(have)), have)
            window = low.copy()
            same = owner[1:] == owner[:-1]
            np.minimum(low[:-1], low[1:], out=window[:-1], where=same)
            hits = np.flatnonzero(filters[k][(window & np.uint64(0xFFFF)).astype(np.int64)])
            for j in hits.tolist():
                for i in where[k].get(int(window[j]), ()):
                    found.add((int(full[owner[j]]), i))
    return found


PAIRS = "doc_id long, item_id long, shared long, shingles long, containment double"


_PREPARED: dict[str, Items] = {}


def _prepared(name: str, shared: Broadcast) -> Items:
    """A block's items, made once a worker; one block is held at a time."""
    if name not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[name] = Items(shared.value)
    return _PREPARED[name]


def _search(docs: DataFrame, shared: Broadcast, least: float) -> DataFrame:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _prepared(name, shared)
        hashes = Hashes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [words(t) for t in part.column(1).to_pylist()]
                ids, out, own = part.column(0).to_pylist(), [], {}
                for d, i in sorted(candidates([hashes.of(ws) for ws in texts], items)):
                    if d not in own:
                        own[d] = shingles(texts[d])
                    item, wanted = items.rows[i]
                    both = len(wanted & own[d])
                    if both >= least * len(wanted):
                        out.append({"doc_id": ids[d], "item_id": item, "shared": both, "shingles": len(wanted), "containment": both / len(wanted)})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("shingles", pa.int64()), ("containment", pa.float64())]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, PAIRS)


def _blocks(benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Items (item_id, text, block), written, and how many blocks they are dealt to by hash: as many as keep each block within BLOCK
    rows and BLOCK_CHARS characters, or at one item. Only the largest block's size comes to the driver."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows, parts = scratch.keep(rows, "items"), 1
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("block")
        sizes = rows.groupBy(block).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).where("n > 1")
        n, chars = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("chars"), F.lit(0))).first()
        over = max(n / BLOCK, chars / BLOCK_CHARS)
        if over <= 1:
            return rows.select("item_id", "text", block), parts
        parts = max(parts + 1, math.ceil(1.2 * over * parts))


def contained(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Columns as in PAIRS: every (document, item) where the document holds at least `least` of the item's shingles."""
    scratch = Scratch(docs.sparkSession, "contained")
    items, parts = _blocks(benchmark, scratch)
    passes = []
    for k in range(parts):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.col("block") == k).select("item_id", "text").collect()]  # one block
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        found = _search(docs, shared, least)
        if parts > 1:  # a pass ends before the next block is held
            found = scratch.keep(found, f"pass{k}")
            shared.destroy()
        passes.append(found)
    return reduce(DataFrame.union, passes)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all their columns, whose document contains no item."""
    hit = contained(docs, benchmark, least).select(F.col("doc_id").alias("__hit")).distinct()
    hit = Scratch(docs.sparkSession, "decontaminate").keep(hit, "hit")  # of known size, so that documents aren't shuffled for a few ids
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__hit"]), "left_anti")

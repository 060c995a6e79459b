"""Ranked lexical search, document at a time over compressed postings.

build() cuts the documents into shards of about SHARD_TOKENS tokens, each of one task's rows, and writes for each shard a row of its
documents, and for each of its terms a row of postings: document ordinals in the order of doc_id as gaps, then how often the
term stands in each, all as variable-length numbers of seven bits a byte. search() reads the rows of the queries' terms alone.

A shard is searched query by query: a heap merges the k lists' cursors by document, and a heap of at most `k` results, keyed by
score and then by doc_id, keeps the best. A list's contributions are computed once a shard, in exact integers. Lists whose
largest contributions together cannot reach the score that a result needs are not merged but looked up for the documents that
the others bring (so no document that could be a result is missed). What a result needs comes from a first pass of the same search
that merges only each query's rarest terms and scores the documents they bring in full: the k-th best of those scores can be no more than the
k-th best of all. Results of all shards are merged by a window that keeps k rows a query.

Term frequencies, document frequencies and totals are over all documents. Queries go to shards in groups of about
QUERIES_AT_ONCE by hash of their id, as arrays beside each term's postings, so no query and no result passes the driver; a task
holds one shard's postings of one group's terms.

Defined results: a null text or query has no terms; a document without terms counts nowhere; repeated rows are documents of
their own, each with a row; rows of one item id, null among them, are one query; a null doc_id sorts last, and 2^63 - 1 stands for it; equal scores by
ascending doc_id; a text longer than a shard is a shard of its own; empty tables give no rows. Only doc_id and text, and
item_id and text, are read.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.scratch import Scratch

SHARD_TOKENS = 2 << 20
QUERIES_AT_ONCE = 1024
#: The first pass merges a query's rarest terms until they stand in this many times k documents.
LEAD = 20
#: (query, term) rows up to this many are broadcast; more are joined by shuffle.
FEW = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term in UTF-8 once A-Z are lower: whatever isn't ASCII, or is a letter or a digit.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same for Spark's strings.
TERM_OF_TEXT = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
SHARDS = "shard string, term string, df long, tokens long, data binary"
NULL_ID = 2**63 - 1


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each number begins and all end) of numbers from 0 up: seven bits a byte, the lowest first; a byte's top bit
    says that more follow."""
    left = numbers.astype(np.uint64)
    size = np.ones(len(left), np.int64)
    for k in range(1, 10):
        size += left >= np.uint64(1 << (7 * k))
    end = np.concatenate([[0], np.cumsum(size)])
    at = end[:-1]
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = ((left[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, end


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], b[:-1] < 128]))
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first).astype(np.int64)


class _Shard:
    """Documents of one shard, until its rows are made."""

    def __init__(self):
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.ids: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = TERM.findall(text.lower()) if text else ()
        if found:
            self.ids.append(NULL_ID if doc_id is None else doc_id)
            self.tokens.append(np.fromiter(map(self.terms.__getitem__, found), np.int64, len(found)))
            self.n += len(found)

    def rows(self, name: str) -> pa.RecordBatch:
        order = np.argsort(np.array(self.ids, np.int64), kind="stable")
        lengths = np.array([len(t) for t in self.tokens], np.int64)[order]
        ordinal = np.repeat(np.arange(len(order)), lengths)
        names = list(self.terms)
        by_name = np.empty(len(names), np.int64)
        by_name[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        key = by_name[np.concatenate([self.tokens[i] for i in order])] * len(order) + ordinal
        key, tf = np.unique(key, return_counts=True)
        term, ordinals = key // len(order), key % len(order)
        first = np.searchsorted(term, np.arange(len(names) + 1))
        gaps = np.diff(ordinals, prepend=0)
        gaps[first[:-1]] = ordinals[first[:-1]]
        # A term's gaps, then its frequencies, and so on for all terms.
        numbers, i = np.empty(2 * len(key), np.int64), np.arange(len(key))
        numbers[first[term] + i], numbers[first[term + 1] + i] = gaps, tf
        lists, end = packed(numbers)
        ids = np.array(self.ids, np.int64)[order]
        head = ids.tobytes() + packed(lengths)[0].tobytes()
        offsets = np.concatenate([[0], len(head) + end[2 * first]]).astype(np.int64)
        data = pa.Array.from_buffers(pa.large_binary(), len(names) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(head + lists.tobytes())]).cast(pa.binary())
        n = len(names) + 1
        columns = [pa.array([name] * n), pa.array([None, *(t.decode() for t in sorted(names))], pa.string()), pa.array([len(order), *np.diff(first).tolist()], pa.int64()), pa.array([self.n, *[None] * len(names)], pa.int64()), data]
        return pa.record_batch(columns, names=["shard", "term", "df", "tokens", "data"])


@dataclass(frozen=True)
class Postings:
    """rows (shard, term, df, tokens, data): a row of null term per shard holds its documents and how many tokens they have."""

    rows: DataFrame

    @property
    def totals(self) -> tuple[int, int]:
        """How many documents have a term, and how many terms they have, repeats included."""
        n, tokens = self.rows.where("term is null").agg(F.sum("df"), F.sum("tokens")).first()
        return n or 0, tokens or 0


def build(docs: DataFrame, scratch: Scratch | None = None, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> Postings:
    """The postings of all terms of all documents, written once. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = _Shard(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.n >= shard_tokens:
                    yield shard.rows(f"{TaskContext.get().partitionId()}-{made}")
                    shard, made = _Shard(), made + 1
        if shard.n:
            yield shard.rows(f"{TaskContext.get().partitionId()}-{made}")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, SHARDS)
    return Postings((scratch or Scratch(docs.sparkSession, "lexical")).keep(rows, "postings"))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM_OF_TEXT), 1)


class _List:
    """A term's documents in one shard, what it adds to each one's score, and the most that it adds."""

    def __init__(self, at: np.ndarray, gain: np.ndarray):
        self.at, self.gain, self.most = at.tolist(), gain.tolist(), int(gain.max())

    @cached_property
    def of(self) -> dict[int, int]:
        return dict(zip(self.at, self.gain, strict=True))


class _Lists:
    """One shard's postings of a group's terms."""

    def __init__(self, head: bytes, n_docs: int, totals: tuple[int, int]):
        self.ids = np.frombuffer(head, np.int64, n_docs)
        n, tokens = totals
        self.m = 50 + (50 * unpacked(head[8 * n_docs :]) * n) // tokens
        self.lists: dict[str, _List] = {}

    def add(self, term: str, w: int, data: bytes) -> None:
        both = unpacked(data)
        at, tf = np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]
        self.lists[term] = _List(at, w * ((1_000_000_000 * tf) // (1000 * tf + 20 * self.m[at])))

    def best(self, terms: list[str], k: int, least: int, lead: set[str] | None = None) -> list[tuple[int, int]]:
        """(score, ordinal) of up to k documents that score `least` or more; with `lead`, of those that have one of its terms."""
        found = sorted((self.lists[t] for t in terms if t in self.lists and (lead is None or t not in lead)), key=lambda x: x.most)
        merged = [self.lists[t] for t in lead or () if t in self.lists]
        bounds = [0]
        for x in found:
            bounds.append(bounds[-1] + x.most)
        # Of the lists by their largest contribution, the first `apart` together stay below what a result needs.
        apart = len(found) if lead is not None else bisect_left(bounds, least) - 1
        merged += found[apart:]
        heap = [(x.at[0], i, 0) for i, x in enumerate(merged)]
        heapq.heapify(heap)
        results: list[tuple[int, int]] = []  # (score, -ordinal): the worst first
        while heap:
            doc, score = heap[0][0], 0
            while heap and heap[0][0] == doc:
                _, i, j = heap[0]
                at, gain = merged[i].at, merged[i].gain
                score += gain[j]
                if j + 1 < len(at):
                    heapq.heapreplace(heap, (at[j + 1], i, j + 1))
                else:
                    heapq.heappop(heap)
            for i in range(apart - 1, -1, -1):
                if score + bounds[i + 1] < least:
                    break
                score += found[i].of.get(doc, 0)
            else:
                if score >= least:
                    if len(results) < k:
                        heapq.heappush(results, (score, -doc))
                    elif (score, -doc) > results[0]:
                        heapq.heapreplace(results, (score, -doc))
                    if len(results) == k and results[0][0] > least:
                        least = results[0][0]
                        while lead is None and apart < len(found) and bounds[apart + 1] < least:  # from now on it is looked up
                            heap = [x for x in heap if merged[x[1]] is not found[apart]]
                            heapq.heapify(heap)
                            apart += 1
        return [(score, -doc) for score, doc in results]


def _searched(rows: DataFrame, k: int, totals: tuple[int, int], first: bool) -> DataFrame:
    """(item_id, doc_id, score) of the best k of each shard, from rows (shard, part, term, df, w, data, asked)."""

    def run(table: pa.Table) -> pa.Table:
        records = table.select(["term", "df", "w", "data", "asked"]).to_pylist()
        head = next(r for r in records if r["term"] is None)
        lists = _Lists(head["data"], head["df"], totals)
        queries: dict[int | None, tuple[list[str], set[str], int]] = {}
        for r in records:
            if r["term"] is not None:
                lists.add(r["term"], r["w"], r["data"])
                for q in r["asked"]:
                    terms, lead, _ = queries.setdefault(q["item_id"], ([], set(), q["least"]))
                    terms.append(r["term"])
                    if q["lead"]:
                        lead.add(r["term"])
        out: list[tuple] = []
        for item, (terms, lead, least) in queries.items():
            out += [(item, int(lists.ids[doc]), score) for score, doc in lists.best(terms, k, least, lead if first else None)]
        item, doc, score = zip(*out, strict=True) if out else ((), (), ())
        doc = [None if d == NULL_ID else d for d in doc]
        return pa.table([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return rows.groupBy("shard", "part").applyInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Postings, queries: DataFrame, k: int = 50, scratch: Scratch | None = None, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best documents with a score above 0."""
    scratch = scratch or Scratch(queries.sparkSession, "lexical")
    n, tokens = index.totals
    asked = queries.select(F.col(item_col).cast("long").alias("item_id"), F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term")).distinct()
    asked = scratch.keep(asked, "asked")
    size = asked.count()
    near = (lambda df: F.broadcast(df)) if size <= FEW else (lambda df: df)
    held = scratch.keep(index.rows.where("term is not null").join(near(asked.select("term").distinct()), "term", "left_semi").select("shard", "term", "df", "data"), "held")
    w = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("total") + 1))).cast("long")
    weights = scratch.keep(held.groupBy("term").agg(F.sum("df").alias("total")).withColumn("w", w).where("w > 0"), "weights")
    parts = max(1, -(-asked.select("item_id").distinct().count() // QUERIES_AT_ONCE))
    before = Window.partitionBy("item_id").orderBy("total", "term").rowsBetween(Window.unboundedPreceding, -1)
    known = asked.join(near(weights), "term").withColumn("lead", F.coalesce(F.sum("total").over(before), F.lit(0)) < LEAD * k)
    known = scratch.keep(known.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")), "known")
    heads = index.rows.where("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "term", "df", F.lit(0).cast("long").alias("w"), "data")

    def rows(least: DataFrame) -> DataFrame:
        of = F.struct("item_id", "lead", "least").alias("q")
        lists = least.groupBy("part", "term", "w").agg(F.collect_list(of).alias("asked"))
        beside = held.join(near(lists), "term").select("shard", "part", "term", "df", "w", "data", "asked")
        return beside.unionByName(heads.withColumn("asked", F.lit(None).cast(beside.schema["asked"].dataType)))

    first = _searched(rows(known.withColumn("least", F.lit(1).cast("long"))), k, (n, tokens), True)
    needed = _ranked(first, k).groupBy(F.col("item_id").alias("of")).agg(F.count("*").alias("n"), F.min("score").alias("score"))
    needed = scratch.keep(needed.where(F.col("n") == k).select("of", "score"), "needed")
    least = known.join(near(needed), F.col("item_id").eqNullSafe(F.col("of")), "left").withColumn("least", F.coalesce("score", F.lit(1).cast("long")))
    found = _searched(rows(least), k, (n, tokens), False)
    return _ranked(found, k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """search() of `queries` over the postings of `docs`."""
    scratch = Scratch(docs.sparkSession, "lexical")
    return search(build(docs, scratch), queries, k, scratch)
